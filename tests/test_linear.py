"""Functions of texts: automata against difflib and regular expressions, and time and results on hostile texts."""

import difflib
import random
import re
import time

import pytest

from lexaria.functions import alignment, preserve, spans
from lexaria.functions.automata import SuffixAutomaton, TermIndex, matching_runs
from lexaria.operators import filters, stages
from lexaria.sources import loaders


def test_matching_runs_are_difflibs():
    rng = random.Random(3)
    for _ in range(1500):
        letters = rng.choice(["ab", "abc", "abcdefgh", [str(i) for i in range(40)]])
        a, b = ([rng.choice(letters) for _ in range(rng.randint(0, 40))] for _ in range(2))
        if rng.random() < 0.5:
            b = [rng.choice(letters) if rng.random() < 0.2 else x for x in a if rng.random() > 0.1]
        assert matching_runs(a, b) == [tuple(m) for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()]


def test_suffix_automaton_has_all_runs():
    text = "abcbcabbca"
    automaton = SuffixAutomaton(text)
    assert [n for _, n in automaton.walk("bcbcxabbcab")] == [1, 2, 3, 4, 0, 1, 2, 3, 4, 5, 4]
    assert max(n for _, n in automaton.walk(text)) == len(text) and max(n for _, n in automaton.walk(text, 3)) == 3


def test_terms_are_found_as_by_patterns():
    rng = random.Random(4)
    for _ in range(600):
        text = "".join(rng.choice("ab -.xX\n") for _ in range(60))
        terms = [t for t in ("".join(rng.choice("ab -.x") for _ in range(rng.randint(1, 6))).strip(" -") for _ in range(6)) if t]
        for flexible in (True, False):
            index = TermIndex(terms, flexible)
            places = index.places(text)
            for term, number in zip(terms, index.of, strict=True):
                pattern = r"[\s-]+".join(map(re.escape, re.split(r"[\s-]+", term))) if flexible else re.escape(term)
                want = [m.span() for m in re.finditer(rf"(?<!\w){pattern}(?!\w)", text, re.IGNORECASE)]
                assert [(s, e) for s, e, t in places if t == number] == want, (text, term)


def test_term_index_of_nothing():
    assert TermIndex([]).places("a b") == [] and TermIndex(["", " - "]).of == [-1, -1] and TermIndex(["a"]).places("") == []
    index = TermIndex(["b c", "B  C", "c"])
    assert index.of == [0, 0, 1] and index.places("a B-c") == [(2, 5, 0), (4, 5, 1)] and index.bytes() < 2000


HOSTILE = {
    "names": ("Ab. ", lambda t: preserve.entities(t)),
    "other names": ("Ab cd. Abc ", lambda t: preserve.missing(preserve.entities(t), t.lower())),
    "checks": ("Ab 12. not ", lambda t: preserve.explicit_checks(t, t)),
    "negations": ("not a. ", stages.flatten_negation),
    "denied": ("It is not unhappy. ", stages.flatten_negation),
    "buts": ("it is not unhappy but not un ", stages.flatten_negation),
    "phrases in code": ("`x` prior to ", stages.phrases(most=10**9)),
    "candidates": ("`a` bb ", lambda t: filters.candidates(t, frozenset(), spans.literal_spans(t))),
    "grammar": ("  ", stages.mend_grammar),
    "articles": ("a apple ", stages.mend_grammar),
    "ticks": ("`a ``b ", spans.literal_spans),
    "open ticks": ("` `` ``` ```` ", spans.literal_spans),
    "fences": ("```\nx\n~~~\n", spans.literal_spans),
    "backslashes": ("\\\\`", spans.literal_spans),
    "sentences": ("A b. ", lambda t: alignment.aligned_sentences(t, t[: len(t) // 2])),
    "changes": ("ab cd ", lambda t: alignment.changed_token_rate(t, t.replace("cd", "x", 1000))),
    "swaps": ("ab cd ", lambda t: alignment.window_pair(t, t[:-3] + "x", 6)),
    "prose": ("A word here goes. ", lambda t: filters.prose_windows([t], (20, 60))),
    "lists": ("U.S. Gov. ", preserve.sentence_list),
    "dictionary": ("the cat ", stages.dictionary({"the": "a", "the cat": "a dog"})),
    "finder": ("in order-to ", stages.phrase_finder([{"in order to": "to"}, {"order": "command"}])),
    "spans": ("of the ", lambda t: spans.phrase_spans(t, [["of the", "the of the"], ["the", "of"]])),
    "tags": ("<p><b>x", loaders.blocks_of),
    "closed tags": ("</p></div>", loaders.blocks_of),
    "accents": ("´ e", preserve.fix_accents),
}


@pytest.mark.parametrize("name", sorted(HOSTILE))
def test_time_is_linear(name):
    """Twice the text takes about twice the time: at most three times, in one of four trials, so that a busy machine doesn't tell."""
    piece, function = HOSTILE[name]

    def seconds(size):
        text = piece * (size // len(piece))
        began = time.process_time()
        function(text)
        return time.process_time() - began

    seconds(20_000)
    assert any(seconds(200_000) <= 3 * max(seconds(100_000), 0.02) for _ in range(4))


def test_long_alignment():
    """Every other word replaced: a search for one longest run after the other would look at all of the rest 50,000 times."""
    a = [f"w{i}" for i in range(100_000)]
    assert sum(n for _, _, n in matching_runs(a, [x if i % 2 else f"z{i}" for i, x in enumerate(a)])) == 50_000


def test_edits_and_choices():
    rng = random.Random(6)
    for _ in range(300):
        found = [(s := rng.randrange(30), s + rng.randint(1, 6)) for _ in range(rng.randint(0, 8))]
        taken: list[tuple[int, int]] = []
        for x in sorted(found, key=lambda x: (x[0] - x[1], x[0])):
            if all(x[1] <= y[0] or y[1] <= x[0] for y in taken):
                taken.append(x)
        assert spans.longest_first(found) == sorted(taken)
        held = spans.Taken(taken)
        assert all(held.meets(*x) == any(spans.overlaps(x, y) for y in taken) for x in found + [(3, 4), (0, 40)])
    assert spans.apply_edits("abcdef", [(4, 5, "X"), (0, 0, "<"), (1, 3, "")]) == "<adXf"


def test_window_rules_of_sources():
    text = "The old town lies on a river that flows to the sea. Thank you for the long road that led us here."
    assert filters.window_reason(text, (8, 40)) == "kept" and filters.window_reason(text, (8, 40), source="speech") == "banned"
    label = "The usual dose is low in old age (5.1). It should be taken with plenty of water."
    assert filters.window_reason(label, (8, 40)) == "kept" and filters.window_reason(label, (8, 40), source="openfda") == "banned"
    heading = "Lithium No relevant changes were seen in the old group. It should be taken with water."
    assert filters.window_reason(heading, (8, 40)) == "kept" and filters.window_reason(heading, (8, 40), source="openfda") == "heading"
    assert filters.window_reason("", (0, 40)) == "length"
