"""Leaks with names that open sentences, in another case, with changed words and gaps, and of items without enough words."""

from topograph.llm import decontaminate
from topograph.llm.decontaminate import Benchmark, Canon


def leaks(item, *texts):
    return [[(round(c, 2), same) for _, c, same, _ in own] for own in Benchmark([(1, item)]).leaks(list(texts), Canon())]


def test_names_that_open_sentences():
    item = "Tom has 12 red marbles in a jar. Tom gives 5 marbles to a friend. Tom then finds 7 more on the way home."
    text = item.replace("Tom", "Ben").replace("12", "31").replace("5", "9").replace("7", "4")
    assert leaks(item, text, "Before. " + text.lower(), text.replace("Ben", "Max", 1)) == [[(1.0, False)], [(1.0, False)], []]


def test_case():
    item = "On Monday Alice met Bob in Paris and on Tuesday Alice saw Carol in Rome with all of her friends."
    assert leaks(item, item.lower(), "So it went. " + item.upper(), item) == [[(1.0, True)]] * 3


def test_changed_words_and_gaps():
    item = "The red fox jumps over the lazy dog while many birds sing in old trees."
    assert leaks(item, item.replace("while", "as"), item.replace("dog while", "dog and so on while"), "The red fox jumps over the wall and is gone.") == [[(0.93, True)], [(1.0, True)], []]


def test_items_without_enough_words():
    for item in ("What is 3 + 4 * 12 - 7 / 2 ?", "1 2 3 4 5 6 7 8", "7, 11 and 13"):
        assert leaks(item, f"Before that. {item} And after.", item.replace("3", "5").replace("7 8", "8 7")) == [[(1.0, True)], []]
    assert leaks("Two words", "Before. Two words.\nAfter", "two words") == [[(1.0, True)]] * 2
    assert leaks("Paris", "Capital?\nParis\nNo", "He went to Paris with her.") == [[(1.0, True)], []]
    assert leaks("3 - 4 = -1", "so 3 - 4 = -1 here", "so 3 + 4 = -1 here", "so 3 - 4 = 1 here") == [[(1.0, True)], [], []]


def test_equal_numbers_of_different_units():
    item = "The farm lies 3 km from the mill and 3 miles from the old church near the river bank."
    own = decontaminate.Benchmark([(1, item)])
    texts = [item.replace("3 km", "4 km").replace("3 miles", "5 miles"), item.replace("3 km", "4 km")]
    assert [[x[0] for x in found] for found in own.leaks(texts, decontaminate.Canon())] == [[1], [1]]
    same = decontaminate.Benchmark([(1, item.replace("miles", "km"))])
    assert same.leaks([item.replace("miles", "km").replace("3 km from the old", "7 km from the old")], decontaminate.Canon()) == [[]]
