from hypothesis import given, settings
from hypothesis import strategies as st

from noticeflow.llm.repeats import SPAN, first_holders
from noticeflow.llm.suffixes import suffix_array


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=60))
def test_suffix_array_is_the_sorted_order(items):
    text = [*items, 0]
    assert suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def test_suffix_array_of_periodic_and_empty_texts():
    assert suffix_array([]) == []
    for text in ([1] * 50 + [0], [2, 1] * 30 + [0], [1, 2, 3] * 20 + [1, 2, 0]):
        assert suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def test_first_holders_take_the_smallest_id_of_equal_windows():
    a = bytes(range(65, 65 + SPAN + 2))
    found = first_holders([(a, 7), (a[1:], 3), (b"x" + a[:SPAN], 9)])
    assert found == [[7, 3, 3], [3, 3], [9, 7]]
