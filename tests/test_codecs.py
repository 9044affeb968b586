"""Pure functions: edit scripts, correction bytes, trees."""

from hypothesis import given, settings
from hypothesis import strategies as st

from grainline.functions import editscript as e
from grainline.operators import trees

text = st.text(max_size=30)


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(deadline=None, max_examples=300)
@given(text, text)
def test_script_is_shortest_and_applies(a, b):
    found = e.script(a, b)
    assert e.apply(a, found) == b
    assert e.cost(found) == plain_distance(a, b)
    assert e.decode(e.encode(found)) == found


def test_script_of_long_and_non_ascii_text():
    a, b = "x" * 700 + "é" * 300, "x" * 255 + "日本" + "x" * 445 + "é" * 299 + "ÿ"
    found = e.script(a, b)
    assert e.apply(a, e.decode(e.encode(found))) == b


@given(st.lists(st.tuples(st.integers(0, 2**26), st.integers(0, 12)), max_size=40))
def test_gap_bytes(rows):
    gaps, symbols = [g for g, _ in rows], [s for _, s in rows]
    assert e.gaps_of(e.gap_bytes(gaps, symbols)) == (gaps, symbols)


@settings(deadline=None, max_examples=60)
@given(st.lists(text, max_size=25), st.sampled_from(["word_bag", "edit_distance"]), st.integers(1, 5))
def test_windowed_tree_has_one_parent_each_and_no_cycle(lines, method, w):
    up = trees.windowed(lines, method, w)
    for k in range(len(lines)):
        seen = set()
        while up[k] != k:
            assert k not in seen
            seen.add(k)
            assert abs(up[k] - k) <= trees.REACH
            k = up[k]


def test_equal_lines_hang_on_the_earlier():
    assert trees.windowed(["abc", "abc", "zzzz"], "word_bag", 2)[1] == 0
