"""Queries of the rewrite stages, alignments, spans and text filters, over all documents.

What they compute are plain functions in Arrow batches (alignment, parsing and rules
have no SQL form); tests hold them against worked examples and plain loops.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexaria.functions import alignment, preserve, spans
from lexaria.functions.batches import dealt, rows_of
from lexaria.operators import filters, stages
from lexaria.plans.text_queries import _PAIRS_SQL, RULES, _rewrites, read
from lexaria.sources import lines

#: Further rules for the arms: what a word may be replaced by, with a score.
OPTIONS = {k: [(v, 0.9), (v + v, 0.2)] for k, v in RULES.items()}


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(read(spark, sf_dir, "documents").select("doc_id", "lang", "text"))


def _staged(spark: SparkSession, sf_dir: str, stage: stages.Stage) -> DataFrame:
    out = _docs(spark, sf_dir).withColumn("r", stages.run(stage, F.col("text")))
    return out.select("doc_id", F.size("r.edits").alias("n_edits"), F.col("r.output").alias("output"), F.col("r.edits").alias("edits"), "text")


def word_stage() -> stages.Stage:
    """Generates from the rules, turns down by the window veto, and fills the place with the next candidate."""
    return stages.swap_words(
        lambda w: OPTIONS.get(w, []), lambda w: w.lower() in OPTIONS, stages.window_veto(stages.overlap_entailment, 0.5, checks=stages.keeps_items),
        most=3
    )


def whole_chain() -> stages.Stage:
    """Grammar, negation, clauses, phrases and words, each undone where it loses an item, all undone where a code literal changes."""
    checked = [
        stages.guarded(s, [stages.keeps_literals]) for s in (
            stages.by_sentence(stages.mend_grammar), stages.flatten_negation, stages.by_sentence(stages.split_clauses), stages.phrases(most=3)
        )
    ]
    return stages.chain([*checked, word_stage()])


def stage_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole words replaced in their case, the longest rule first."""
    return _staged(spark, sf_dir, stages.dictionary(RULES)).select("doc_id", "n_edits", F.md5(F.col("output").cast("binary")).alias("output_md5"))


def stage_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order: edits by stage."""
    x = _staged(spark, sf_dir, whole_chain())
    return x.select(
        "doc_id", "n_edits", F.array_join(F.array_sort(F.array_distinct(F.transform("edits", lambda e: e["stage"]))), ",").alias("stages"),
        (F.col("output") != F.col("text")).alias("changed")
    )


def rewrite_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each arm of the ablation on every document: changed texts and edits."""
    factors = {
        "grammar": {"off": stages.identity, "rules": stages.mend_grammar}, "words": {"off": stages.identity, "dictionary": stages.dictionary(RULES)},
        "phrases": {"off": stages.identity, "authored": stages.phrases()}
    }
    made = stages.arms(factors, {"grammar": "off", "words": "dictionary", "phrases": "off"})

    def run(text: str | None) -> list[tuple[str, bool, int]]:
        out = []
        for name, stage in made.items():
            new, edits = stage(text or "")
            out.append((name, new != (text or ""), len(edits)))
        return out

    long = rows_of(_docs(spark, sf_dir), run, "config string, changed boolean, n_edits int", ["lang"], ["text"])
    return long.groupBy("config", "lang").agg(F.count("*").alias("n"), F.count_if("changed").alias("n_changed"), F.sum("n_edits").alias("n_edits"))


def stage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inspection of each rewrite: edits by stage, simplicity, preservation, what is lost."""

    def run(text: str | None) -> tuple:
        new, edits = stages.dictionary(RULES)(text or "")
        r = stages.report(text or "", new, edits)
        return sum(r["edits"].values()), round(r["simplicity"][3], 6), round(r["preservation"][5], 6), len(r["lost"]["numbers"]), len(r["lost"]["entities"])

    return rows_of(_docs(spark, sf_dir), run, "n_edits int, s double, p_meaning double, lost_numbers int, lost_entities int", ["doc_id"], ["text"])


def veto_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each rule's first place in a text as a single swap: passed or turned down, with the words around it."""
    veto = stages.window_veto(stages.overlap_entailment, 0.9)
    single = [(source, stages.dictionary({source: target})) for source, target in RULES.items()]

    def run(text: str | None) -> list[tuple[str, bool, int]]:
        out = []
        for source, stage in single:
            new, edits = stage(text or "")
            if edits:
                _, s, e, r = edits[0]
                swapped = text[:s] + r + text[e:]
                out.append((source, veto(text, swapped), len(alignment.window_pair(text, swapped, 6)[0].split())))
        return out

    long = rows_of(_docs(spark, sf_dir), run, "word string, vetoed boolean, words int", ["lang"], ["text"])
    return long.groupBy("lang", "word").agg(F.count("*").alias("n"), F.count_if("vetoed").alias("n_vetoed"), F.max("words").alias("most_words"))


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts after each edit of the phrase and word stages: how many, and the digest of the last."""

    def run(text: str | None) -> tuple[int, str]:
        new, edits = stages.phrases(most=3)(text or "")
        shots = alignment.snapshots(text or "", sorted(edits, key=lambda e: -e[1]), new)
        return len(shots), hashlib.sha256(shots[-1][1].encode()).hexdigest()

    return rows_of(_docs(spark, sf_dir), run, "n_shots int, last_sha256 string", ["doc_id"], ["text"])


def edit_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits of each pair by kind, and whether it is a single swap."""

    def run(a: str | None, b: str | None) -> tuple[int, int, int, bool]:
        found = alignment.edits(a or "", b or "")
        kinds = [k for k, _, _ in found]
        return kinds.count("replace"), kinds.count("delete"), kinds.count("insert"), alignment.single_swap(a or "", b or "") is not None

    return rows_of(_rewrites(spark, sf_dir), run, "n_replace int, n_delete int, n_insert int, single boolean", ["doc_id"], ["a", "b"])


def sentence_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of sentences linked by aligned words, and how many of them changed."""

    def run(a: str | None, b: str | None) -> tuple[int, int]:
        groups = alignment.aligned_sentences(a or "", b or "")
        return len(groups), sum(x != y for x, y in groups)

    return rows_of(_rewrites(spark, sf_dir), run, "n_groups int, n_changed int", ["doc_id"], ["a", "b"])


def window_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two windows of six words around the change of each rewrite."""
    return rows_of(
        _rewrites(spark, sf_dir), lambda a, b: tuple(len(x.split()) for x in alignment.window_pair(a or "", b or "", 6)), "before int, after int",
        ["doc_id"], ["a", "b"]
    )


def text_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code literals, acronym definitions, names, and words that may be replaced, of each text."""

    def run(text: str | None) -> tuple[int, int, int, int]:
        code = spans.literal_spans(text or "")
        return len(code), len(spans.acronyms(text or "")), len(preserve.entities(text or "")), len(
            filters.candidates(text or "", frozenset(preserve.OPENERS), code)
        )

    return rows_of(_docs(spark, sf_dir), run, "n_literals int, n_acronyms int, n_entities int, n_candidates int", ["doc_id"], ["text"])


def acronym_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Acronyms with several expansions, by source: of the texts put together from the sources' documents, each document on its own first."""
    found = rows_of(
        read(spark, sf_dir, "documents").select("source", "text"), lambda t: spans.acronyms(t or ""), "acronym string, expansion string", ["source"],
        ["text"]
    )
    return found.groupBy("source", "acronym").agg(F.count_distinct("expansion").alias("n")).filter("n > 1")


def term_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of phrases by two sources in order of priority, the longest first inside a source."""
    sources = [["of the", "in the", "and the"], ["the", "of", "de la", "en la"]]
    long = rows_of(_docs(spark, sf_dir), lambda t: spans.phrase_spans(t or "", sources), "start int, stop int, rank int", ["doc_id"], ["text"])
    return long.groupBy("doc_id").agg(
        F.count_if(F.col("rank") == 0).alias("first"), F.count_if(F.col("rank") == 1).alias("second"),
        F.sum(F.col("stop") - F.col("start")).alias("chars")
    )


def text_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned text, broken words put together, accents joined, articles mended: digests."""

    def run(text: str | None) -> tuple[str, int]:
        t = spans.repair_articles(preserve.clean(preserve.fix_accents(preserve.dehyphenate(text or ""))))
        return hashlib.sha256(t.encode()).hexdigest(), len(preserve.sentence_list(t))

    return rows_of(_docs(spark, sf_dir), run, "sha256 string, n_sentences int", ["doc_id"], ["text"])


def prose_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prose windows of each text's paragraphs, and three that share no sentence, in hash order."""

    def run(blocks: list[str] | None) -> tuple[int, int]:
        found = filters.prose_windows([preserve.clean(b) for b in blocks or []], (20, 60))
        chosen = filters.pick_windows([w[:3] for w in found], 3, lambda w: hashlib.sha256(str(w).encode()).hexdigest())
        return len(found), len(chosen or [])

    return rows_of(
        _docs(spark, sf_dir).withColumn("blocks", lines.paragraphs(F.col("text"), "text")), run, "n_windows int, n_chosen int", ["doc_id"], ["blocks"]
    )


def pair_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why consecutive sentences of a text are no split pair and no reference: counts by reason."""

    def run(text: str | None) -> list[tuple[str, str]]:
        s = preserve.sentence_list(text or "")
        out = []
        for i in range(0, len(s) - 1, 2):
            source = s[i][:-1] + " " + s[i + 1]
            out.append((filters.split_pair_reason(source, [s[i], s[i + 1]]), filters.reference_reason(source, f"{s[i]} {s[i + 1]}")))
        return out

    return rows_of(_docs(spark, sf_dir), run, "split string, reference string", ["lang"], ["text"]).groupBy("split", "reference").agg(F.count("*").alias("n"))


def source_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences that can be sources, each once (by hash), with its first document."""
    long = rows_of(
        _docs(spark, sf_dir),
        lambda t: [(hashlib.sha256(s.encode()).hexdigest(), len(s.split())) for s in preserve.sentence_list(t or "") if filters.source_sentence(s)],
        "sha256 string, n_words int", ["doc_id"], ["text"]
    )
    return long.groupBy("sha256").agg(F.min("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"))


QUERIES = {
    f.__name__: f
    for f in (
        stage_dictionary, stage_chain, rewrite_arms, stage_report, veto_decisions, snapshots, edit_alignment, sentence_alignment, window_pairs, text_spans, acronym_conflicts, term_spans, text_cleanup,
        prose_windows, pair_reasons, source_sentences,
    )
}

_KEYS = ", ".join(f"'{k}'" for k in sorted(RULES))
_MAP = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in sorted(RULES.items())) + "}"
_PIECES = r"regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+')"
_CASED = f"""CASE WHEN lower(t) NOT IN ({_KEYS}) THEN t WHEN length(t) > 1 AND t = upper(t) THEN upper({_MAP}[lower(t)])
    WHEN left(t, 1) = upper(left(t, 1)) THEN upper(left({_MAP}[lower(t)], 1)) || substr({_MAP}[lower(t)], 2) ELSE {_MAP}[lower(t)] END"""

ORACLES: dict[str, str] = {
    "stage_dictionary": f"""WITH p AS (SELECT doc_id, {_PIECES} AS p FROM documents)
        SELECT doc_id, len(list_filter(p, lambda t: lower(t) IN ({_KEYS})))::INT AS n_edits, md5(array_to_string(list_transform(p, lambda t: {_CASED}), '')) AS output_md5 FROM p""",
    "window_pairs": f"""WITH {_PAIRS_SQL}, t AS (SELECT doc_id, regexp_split_to_array(trim(array_to_string(source, ' '), chr(10) || chr(9) || ' '), '\\s+') AS a,
            regexp_split_to_array(trim(array_to_string(output, ' '), chr(10) || chr(9) || ' '), '\\s+') AS b FROM q),
        d AS (SELECT doc_id, len(a) AS n, list_filter(range(1, len(a) + 1), lambda i: a[i] <> b[i]) AS x FROM t),
        w AS (SELECT doc_id, CASE WHEN len(x) = 0 THEN n ELSE least(6, x[1] - 1) + x[-1] - x[1] + 1 + least(6, n - x[-1]) END::INT AS k FROM d) SELECT doc_id, k AS before, k AS after FROM w""",
}
