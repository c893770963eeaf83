from hypothesis import given, settings
from hypothesis import strategies as st

from signet.llm.suffix_array import END, SEPARATOR, SHIFT, lyndon_groups, previous_smaller, suffix_array
from signet.llm.suffix_dedup import covered_windows


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab\x01é", max_size=60))
def test_suffix_array(text):
    t = text.encode().translate(SHIFT) + SEPARATOR + END
    assert suffix_array(t) == sorted(range(len(t)), key=lambda i: t[i:])


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="abc", max_size=40))
def test_groups_are_lyndon_prefixes(text):
    t = text.encode().translate(SHIFT) + END
    groups, number = lyndon_groups(t, previous_smaller(t))

    def prefix(i):
        j = i + 1
        while j < len(t) and t[j:] > t[i:]:
            j += 1
        return t[i:j]

    names = [{prefix(i) for i in g} for g in groups]
    assert all(len(n) == 1 for n in names) and [n.pop() for n in names] == sorted({prefix(i) for i in range(len(t))})
    assert all(number[i] == k for k, g in enumerate(groups) for i in g)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="ab", max_size=30).map(str.encode), st.integers(0, 4)), min_size=1, max_size=6))
def test_covered_windows(parts):
    got = covered_windows([p for p, _ in parts], [r for _, r in parts], 5)
    for (p, r), starts in zip(parts, got, strict=True):
        want = [k for k in range(len(p) - 4) if any(p[k : k + 5] in q for q, s in parts if s < r)]
        assert starts.tolist() == want
