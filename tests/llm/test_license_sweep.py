"""The sweep over spans against a comparison of all with all, and its time on a text of many notices."""

import random
import time
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from fleetlens.llm import licenses

SPAN = st.tuples(st.sampled_from([0.8, 0.9, 1.0]), st.integers(0, 30), st.integers(1, 8), st.sampled_from("abc"))


@settings(max_examples=400, deadline=None)
@given(st.lists(SPAN, max_size=14))
def test_sweep_equals_all_pairs(spans):
    found = [(share, a, a + n, label) for share, a, n, label in spans]
    want = [(share, label) for share, a, b, label in found if not any(x > share and a < to and start < b for x, start, to, _ in found)]
    assert Counter(licenses.fitting_best(found)) == Counter(want)


def test_many_spans_take_time_in_proportion():
    rng = random.Random(3)
    spans = [(rng.choice([0.8, 0.9, 1.0]), a, a + 12, "x") for a in rng.sample(range(2_000_000), 60_000)]
    began = time.perf_counter()
    assert len(list(licenses.fitting_best(spans))) > 40_000
    assert time.perf_counter() - began < 10
