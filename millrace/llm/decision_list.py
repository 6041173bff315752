"""Quality rules: statistics of whole texts, and decision lists learned by sequential covering.

The learner (on the driver, from a bounded labelled sample) grows conjunctions of thresholds that single out rejected
documents, prunes each on rows it was not grown on, and stops when a rule no longer pays. The list is emitted as an
ordered Spark conditional expression, readable as text and evaluated without Python.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from millrace.llm import textcore as tc
from millrace.llm.common import read, ship

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "longest_word")
STATS_SCHEMA = "doc_id long, " + ", ".join(f"{x} long" for x in STATS)
#: Features of the learner, as SQL over the statistics; a text without words has 0 in all.
FEATURES = {
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbol_share": "n_symbols / greatest(word_chars, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "line_words": "n_words / greatest(n_lines, 1)",
    "longest_word": "CAST(longest_word AS DOUBLE)",
}
_SYMBOLS = tc._byte_class(b"#*$%&|<>")
_UPPER = tc._byte_class(range(0x41, 0x5B))
_CONTINUATION = tc._byte_class(range(0x80, 0xC0))


def repeated_words(words: np.ndarray, first: np.ndarray, size: int = 3) -> np.ndarray:
    """Per text: words in windows of ``size`` words that the text has twice or more, the first one included."""
    n, texts = len(words), len(first) - 1
    covered = np.zeros(n + 1, dtype=np.int64)
    if n >= size:
        owner = np.repeat(np.arange(texts), np.diff(first))
        at = np.flatnonzero(owner[: n - size + 1] == owner[size - 1 :])
        with np.errstate(over="ignore"):
            keys = tc.mix(tc.shingle_hashes(words, size)[at] ^ tc.mix((owner[at].astype(np.uint64) + tc.U64(1)) * tc.U64(0xA24BAED4963EE407)))
        ordered = np.sort(keys)
        twice = ordered[1:][ordered[1:] == ordered[:-1]]
        if len(twice):
            twice = np.unique(twice)
            near = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
            hits = at[twice[near] == keys]
            for k in range(size):
                covered[hits + k] = 1
    total = np.concatenate(([0], np.cumsum(covered[:n])))
    return total[first[1:]] - total[first[:-1]]


def text_statistics(texts: pa.Array) -> dict[str, np.ndarray]:
    """STATS of each text. A null or empty text has zeros."""
    parts: dict[str, list[np.ndarray]] = {x: [] for x in STATS}
    for _, _, data, offsets in tc.text_slices(texts):
        starts, ends, first = tc.word_spans(data, offsets, tc.SPACED)
        words = tc.span_hashes(data, starts, ends)

        def per_text(flags: np.ndarray) -> np.ndarray:
            total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
            return total[offsets[1:]] - total[offsets[:-1]]  # noqa: B023

        longest = np.zeros(len(first) - 1, dtype=np.int64)
        full = first[1:] > first[:-1]
        if full.any():
            longest[full] = np.maximum.reduceat(ends - starts, first[:-1][full])
        lines, dups = np.zeros(len(first) - 1, dtype=np.int64), np.zeros(len(first) - 1, dtype=np.int64)
        raw = data.tobytes()
        for k in range(len(first) - 1):
            if first[k + 1] > first[k]:
                own = [x for x in raw[offsets[k] : offsets[k + 1]].split(b"\n") if x.strip()]
                lines[k], dups[k] = len(own), len(own) - len(set(own))
        spaced = tc.SPACED[data]
        for name, value in (
            ("n_words", np.diff(first)), ("word_chars", per_text(spaced & ~_CONTINUATION[data])), ("n_symbols", per_text(_SYMBOLS[data])), ("n_dup_lines", dups),
            ("n_repeat_words", repeated_words(words, first)), ("n_lines", lines), ("n_upper", per_text(_UPPER[data])), ("longest_word", longest),
        ):
            parts[name].append(value)
    return {k: np.concatenate(v) if v else np.zeros(0, dtype=np.int64) for k, v in parts.items()}


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = text_statistics(batch.column(1))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(found[x], pa.int64()) for x in STATS)], names=["doc_id", *STATS])


def statistics(documents: DataFrame) -> DataFrame:
    """STATS for each row of ``documents`` (doc_id, text); other columns are ignored."""
    ship(documents.sparkSession)
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInArrow(_statistics, STATS_SCHEMA)


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] > self.threshold if self.above else x[self.feature] <= self.threshold

    def sql(self) -> str:
        return f"({FEATURES.get(self.feature, self.feature)}) {'>' if self.above else '<='} {self.threshold!r}D"


@dataclass
class DecisionList:
    """Ordered rules; the first whose conditions all hold rejects a document. Without one, it is kept."""

    rules: list[list[Condition]] = field(default_factory=list)

    def rejects(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.zeros(len(next(iter(x.values()))), dtype=bool)
        for rule in self.rules:
            out |= np.logical_and.reduce([c.holds(x) for c in rule])
        return out

    def rule_number(self) -> Column:
        """The number of the first rule that holds, from 1; null if none does."""
        out = None
        for k, rule in enumerate(self.rules, 1):
            test = F.expr(" AND ".join(c.sql() for c in rule))
            out = F.when(test, k) if out is None else out.when(test, k)
        return F.lit(None).cast("int") if out is None else out.cast("int")

    def __str__(self) -> str:
        return "\n".join(f"if {' and '.join(f'{c.feature} {">" if c.above else "<="} {c.threshold:.6g}' for c in r)}: reject" for r in self.rules) + "\nelse: keep"


def _gain(p: np.ndarray, n: np.ndarray, p0: float, n0: float) -> np.ndarray:
    return p * (np.log2((p + 1e-9) / (p + n + 1e-9)) - np.log2(p0 / (p0 + n0)))


def _best_condition(x: dict[str, np.ndarray], bad: np.ndarray) -> tuple[float, Condition | None]:
    """The threshold with the highest information gain among the midpoints of all features' distinct values."""
    best, found, p0, n0 = 0.0, None, float(bad.sum()), float((~bad).sum())
    for name in sorted(x):
        order = np.argsort(x[name], kind="stable")
        v, b = x[name][order], bad[order]
        cut = np.flatnonzero(v[1:] > v[:-1])
        if not len(cut):
            continue
        p, n = np.cumsum(b)[cut].astype(float), np.cumsum(~b)[cut].astype(float)
        for above, pp, nn in ((False, p, n), (True, p0 - p, n0 - n)):
            gains = _gain(pp, nn, p0, n0)
            k = int(np.argmax(gains))
            if gains[k] > best + 1e-12:
                best, found = float(gains[k]), Condition(name, above, float((v[cut[k]] + v[cut[k] + 1]) / 2))
    return best, found


def learn(x: dict[str, np.ndarray], bad: np.ndarray, seed: int = 11, most_rules: int = 16, most_conditions: int = 4, precision: float = 0.9, least_support: int = 5) -> DecisionList:
    """Sequential covering: rules for ``bad`` rows, grown on two thirds and pruned on a third of what is not covered yet.

    A pruned rule is taken if, on the rows it was pruned on, ``precision`` of the rows it rejects are bad and it rejects
    ``least_support`` bad rows over all; the first rule that fails this ends the list.
    """
    out, rest = DecisionList(), np.arange(len(bad))
    rng = np.random.default_rng(seed)
    while len(out.rules) < most_rules and bad[rest].sum() >= least_support:
        part = rng.permutation(len(rest))
        grow, prune = rest[part[: 2 * len(part) // 3]], rest[part[2 * len(part) // 3 :]]
        rule: list[Condition] = []
        inside = grow
        while len(rule) < most_conditions and 0 < bad[inside].sum() < len(inside):
            _, found = _best_condition({k: v[inside] for k, v in x.items()}, bad[inside])
            if found is None:
                break
            rule.append(found)
            inside = inside[found.holds({k: v[inside] for k, v in x.items()})]
        if not rule:
            break
        held = {k: v[prune] for k, v in x.items()}

        def worth(conditions: list[Condition]) -> tuple[float, int]:
            hit = np.logical_and.reduce([c.holds(held) for c in conditions])  # noqa: B023
            p, n = int((hit & bad[prune]).sum()), int((hit & ~bad[prune]).sum())  # noqa: B023
            return (p - n) / max(1, p + n), p

        worths = [worth(rule[: k + 1]) for k in range(len(rule))]
        keep = max(range(len(rule)), key=lambda k: (worths[k][0], worths[k][1], -k))
        rule = rule[: keep + 1]
        hit = np.logical_and.reduce([c.holds({k: v[rest] for k, v in x.items()}) for c in rule])
        value, p = worths[keep]
        if p == 0 or (value + 1) / 2 < precision or (hit & bad[rest]).sum() < least_support:
            break
        out.rules.append(rule)
        rest = rest[~hit]
    return out


def training_rows(documents: DataFrame, labels: DataFrame, sample: int) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Features and badness (quality 0) of at most ``sample`` labelled documents, taken by the hash of their ids.

    Labels with null id or quality don't count; of repeated labels the lowest quality holds.
    """
    chosen = (
        labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    # broadcast: at most ``sample`` rows of two numbers
    own = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi")
    rows = statistics(own).join(F.broadcast(chosen), "doc_id").orderBy("doc_id", *STATS).limit(sample).selectExpr("quality", *(f"CAST({v} AS DOUBLE) AS {k}" for k, v in FEATURES.items())).toPandas()
    return {k: rows[k].to_numpy(dtype=float) for k in FEATURES}, (rows["quality"] == 0).to_numpy()


def learned_list(documents: DataFrame, labels: DataFrame, sample: int = 8_000) -> DecisionList:
    """The decision list for these labels; without labelled documents of both kinds it is empty and keeps all."""
    x, bad = training_rows(documents, labels, sample)
    return learn(x, bad) if len(bad) else DecisionList()


def judged(documents: DataFrame, rules: DecisionList, least_words: int = 50, most_repeat_percent: int = 50) -> DataFrame:
    """Statistics of each document, base_failed, the rule that rejects it, and kept.

    A null or empty text has zero statistics and fails the base; rows are judged one by one, so ties and repeated rows
    get the same verdict, and an empty table gives none.
    """
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeat_percent * F.col("n_words"))
    return statistics(documents).withColumn("base_failed", failed).withColumn("rejecting_rule", rules.rule_number()).withColumn("kept", ~F.col("base_failed") & F.col("rejecting_rule").isNull())


def op4_decision_list(spark, sf_dir):
    documents = read(spark, sf_dir, "documents")
    rules = learned_list(documents, read(spark, sf_dir, "labels"))
    return judged(documents, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejecting_rule")


def filter_quality(documents: DataFrame, labels: DataFrame, least_words: int = 50, most_repeat_percent: int = 50) -> DataFrame:
    """The rows of ``documents``, all columns, that the base rules and the learned list keep. No join and no shuffle.

    The statistics travel in one struct column beside the row's own columns, whatever their names.
    """
    rules = learned_list(documents, labels)
    own = documents.columns
    at = own.index("text")
    passed = documents.toDF(*(f"c{k}" for k in range(len(own))))
    schema = StructType([*passed.schema.fields, StructField("s", StructType([StructField(x, LongType()) for x in STATS]))])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = text_statistics(batch.column(at))
            struct = pa.StructArray.from_arrays([pa.array(found[x], pa.int64()) for x in STATS], names=list(STATS))
            yield pa.RecordBatch.from_arrays([*batch.columns, struct], names=[*batch.schema.names, "s"])

    rejected = F.expr(" OR ".join("(" + " AND ".join(_within_struct(c.sql()) for c in r) + ")" for r in rules.rules) or "false")
    failed = (F.col("s.n_words") < least_words) | (100 * F.col("s.n_repeat_words") > most_repeat_percent * F.col("s.n_words"))
    return passed.mapInArrow(add, schema).where(~failed & ~rejected).drop("s").toDF(*own)


def _within_struct(sql: str) -> str:
    return re.sub(r"\b(" + "|".join(STATS) + r")\b", r"s.\1", sql)
