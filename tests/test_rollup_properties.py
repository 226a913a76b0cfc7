"""Properties of the slot roll-up planner (names only)."""
from hypothesis import given, settings
from hypothesis import strategies as st

from gearlens.operators.encode import base_name, rollup_plan, suffix_token

components = st.sampled_from(["battery", "engineOil", "engine", "clutch"])
values = st.sampled_from(["Weak", "Leaking", "Hard", "Oil", "Oil spill", "9", "Yes", "Not Engaging"])
slot_names = st.builds(lambda c, i, v: f"engineTransmission_{c}_cc_value_{i}_{v}", components,
                       st.integers(0, 10), values)
name_lists = st.lists(slot_names, min_size=1, max_size=12, unique=True)


@settings(max_examples=200, deadline=None)
@given(name_lists)
def test_component_mode_partitions_the_names(names):
    plan = rollup_plan(names, "component")
    sources = [s for _, srcs in plan for s in srcs]
    assert sorted(sources) == sorted(names)                  # every name used exactly once
    assert len({n for n, _ in plan}) == len(plan)            # outputs are distinct
    for out, srcs in plan:                                    # same stem and value
        assert all(base_name(s, suffix_token(s)) + "_" + suffix_token(s) == out or
                   s.split("_cc_value_")[0] == out.split("_cc_value_")[0] for s in srcs)


@settings(max_examples=200, deadline=None)
@given(name_lists)
def test_reference_mode_outputs_carry_their_suffix(names):
    plan = rollup_plan(names, "reference")
    outs = [n for n, _ in plan]
    assert len(set(outs)) == len(outs)
    used = [s for _, srcs in plan for s in srcs]
    assert len(used) == len(set(used))                        # a name feeds at most one output
    for out, srcs in plan:
        tok = "_" + out.rsplit("_", 1)[-1]
        assert srcs and set(srcs) <= set(names)
        assert out not in srcs                                # an output that is a source is lost
        assert any(tok in s for s in srcs)                    # the suffix came from a source
