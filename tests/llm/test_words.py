"""Helpers over words of many texts."""

from lodespark.llm.words import powers


def test_powers_take_little_memory():
    """Each Python worker of each executor keeps them."""
    assert sum(x.nbytes for x in powers()) < 4 << 20
