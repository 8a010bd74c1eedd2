"""Laws of the path algebras."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cellweave.functions.semirings import SEMIRINGS

VALUES = {"tropical": st.integers(0, 1000).map(float), "viterbi": st.integers(0, 8).map(lambda k: k / 8), "sum": st.integers(0, 50).map(float), "bool": st.booleans()}


@pytest.mark.parametrize("name", SEMIRINGS)
def test_laws(name):
    s, values = SEMIRINGS[name], VALUES[name]

    @settings(max_examples=60, deadline=None)
    @given(values, values, values)
    def laws(a, b, c):
        assert s.plus(a, b) == s.plus(b, a) and s.plus(s.plus(a, b), c) == s.plus(a, s.plus(b, c)) and s.plus(a, s.zero) == a
        assert s.times(s.times(a, b), c) == s.times(a, s.times(b, c)) and s.times(a, s.one) == a == s.times(s.one, a)
        assert s.times(a, s.plus(b, c)) == s.plus(s.times(a, b), s.times(a, c)) and s.times(s.zero, a) == s.zero

    laws()
