"""Language identification by Bayesian evidence fusion.

Four kinds of evidence: the text (hashed byte trigrams under a multinomial for each language),
the language that the markup or the metadata declares, the suffix of the address, and the host.
Text profiles, what declarations and suffixes say of a language, and host priors are counted over
all rows by grouped aggregation; priors are smoothed from all rows to the host's domain to the
host. Log evidence adds up to a posterior over the languages that are declared and one class
more, for texts in none of them: its profile is the background, half of which is what the
languages have in common and half any trigram at all, and all profiles are smoothed towards it.

Cases. Null, empty and letterless texts have no text evidence: they are rejected, and so are texts
whose best language stays below KEEP and those in none of the languages (language null). The
PROFILES languages that most texts declare, each by LEAST_TEXTS texts at least, have a profile;
all other declarations count as one. A text that is in none of the profiled languages and declares
another one in the form of a language tag is in that one: there is nothing that speaks against it.
Null declarations, addresses and hosts add nothing. Without any declaration there is no language to
learn and all are rejected. Repeated rows come out alike.
A null doc_id is kept. An empty table gives no rows. `accepted` keeps other columns, whatever
their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import LOWER, lean, slices
from .common import chosen, small, stowed, unstowed, written

BITS = 15
#: A language has a profile if at least so many texts declare it, however large the table.
LEAST_TEXTS = 5
#: Profiles at most (0.25 MB each, on the driver and in each task); the rarer languages have none.
PROFILES = 180
# The form of a language tag, and tags that name no language.
_TAG, _NO_TAG = r"^[A-Za-z]{2,3}([-_][A-Za-z0-9]{2,8})*$", r"^(?i:mis|mul|und|zxx)([-_]|$)"
KEEP = 0.5
#: Trigrams overlap, so each counts for less than one independent event.
TEMPER = 0.3
#: What the text may say against all other evidence at most, in nats.
TEXT_NATS = 40.0
#: Pseudo-counts of a host's prior and its domain's.
HOST_WEIGHT, DOMAIN_WEIGHT = 20.0, 50.0
SMOOTH = 0.5
_LETTER = np.zeros(256, bool)
_LETTER[[*range(ord("a"), ord("z") + 1), *range(0xC3, 0xF5)]] = True


def trigrams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket of each byte trigram that has a letter, letters by row), white space as one
    space, A-Z in lower case."""
    low = LOWER[data].copy()
    low[low < 0x21] = 0x20
    n = len(low)
    rows = np.repeat(np.arange(len(off) - 1), np.diff(off))
    letter = _LETTER[low]
    letters = np.bincount(rows[letter], minlength=len(off) - 1)
    if n < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), letters
    x = low.astype(np.uint32)
    code = x[:-2] << 16 | x[1:-1] << 8 | x[2:]
    fine = (rows[:-2] == rows[2:]) & (letter[:-2] | letter[1:-1] | letter[2:])
    code = code[fine]
    return rows[:-2][fine], ((code * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int64), letters


def address(docs: DataFrame) -> DataFrame:
    """docs with suffix and domain of `host` (or null): the part behind the last dot, and the
    last two parts."""
    return docs.withColumn("suffix", F.lower(F.nullif(F.regexp_extract("host", r"\.([A-Za-z]{2,})$", 1), F.lit("")))).withColumn("domain", F.lower(F.coalesce(F.nullif(F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1), F.lit("")), F.lit(""))))


def profiles(docs: DataFrame, languages: list[str]) -> np.ndarray:
    """Log probabilities of trigram buckets by language, from all declared rows, and in the last
    row those of the background."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), 1 << BITS))
        for b in batches:
            lang = b.column(0).to_numpy(zero_copy_only=False)
            for i, j, data, off in slices(b.column(1)):
                row, bucket, _ = trigrams(data, off)
                total += np.bincount(lang[i:j][row].astype(np.int64) << BITS | bucket, minlength=total.size).reshape(total.shape)
        k, at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(total[k, at].astype(np.int64))], ["lang", "bucket", "n"])

    number = F.array_position(F.array(*map(F.lit, languages)), F.col("declared")).cast("int") - 1
    # at most languages x 2 ** BITS rows, however large the corpus
    got = docs.where(F.col("declared").isin(languages)).select(number.alias("lang"), "text").mapInArrow(lean(run), "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros((len(languages) + 1, 1 << BITS))
    total[got.column("lang").to_numpy(), got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    size = total.sum(1, keepdims=True)
    common = (total[:-1] / np.maximum(size[:-1], 1)).sum(0) / max(1, np.count_nonzero(size))
    back = 0.5 / (1 << BITS) + 0.5 * common
    back /= back.sum()
    smooth = SMOOTH * (1 << BITS)
    total += smooth * back
    return np.log(total / (size + smooth))


def likelihoods(docs: DataFrame, table: np.ndarray) -> DataFrame:
    """docs (key columns and text) with letters and ll, tempered log likelihoods by language."""
    kinds = [(f.name, f.dataType.simpleString()) for f in docs.schema.fields if f.name != "text"]
    wide = np.ascontiguousarray(table.T).astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index("text")
            for i, j, data, off in slices(b.column(at)):
                row, bucket, letters = trigrams(data, off)
                ll = np.stack([np.bincount(row, wide[:, k][bucket], j - i) for k in range(wide.shape[1])], axis=1) * TEMPER if wide.shape[1] else np.zeros((j - i, 0))
                if wide.shape[1]:
                    ll -= ll.max(axis=1, keepdims=True)
                    # beyond the limit only the order counts
                    ll = -TEXT_NATS * np.tanh(-ll / TEXT_NATS)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (j - i + 1) * wide.shape[1] or 1, wide.shape[1] or 1, dtype=np.int32)[: j - i + 1] if wide.shape[1] else np.zeros(j - i + 1, np.int32)), pa.array(ll.ravel()))
                rest = [b.column(k).slice(i, j - i) for k in range(b.num_columns) if k != at]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(letters.astype(np.int64)), lists], [n for n, _ in kinds] + ["letters", "ll"])

    return docs.mapInArrow(lean(run), ", ".join(f"{n} {k}" for n, k in kinds) + ", letters long, ll array<double>")


def _normal(logs):
    """Probabilities of an array column of log weights."""
    top = F.array_max(logs)
    e = F.transform(logs, lambda x: F.exp(x - top))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.transform(e, lambda x: x / total)


def fuse(docs: DataFrame, keep: float = KEEP, most: int = PROFILES) -> DataFrame:
    """docs (doc_id, text, declared, host, and columns to carry) with language, confidence,
    text_language and kept."""
    shares = docs.where("declared is not null").groupBy("declared").agg(F.count("*").alias("n"))
    languages = sorted(r["declared"] for r in shares.where(F.col("n") >= LEAST_TEXTS).orderBy(F.desc("n"), "declared").limit(most).collect())
    carried = [c for c in docs.columns if c != "text"]
    other = F.when(F.col("declared").rlike(_TAG) & ~F.col("declared").rlike(_NO_TAG) & ~F.col("declared").isin(languages), F.col("declared"))
    if not languages:
        # a letter for `trigrams` is one of a-z or any from U+00C0 on
        said = F.when(F.col("text").rlike(r"[A-Za-z\x{C0}-\x{10FFFF}]"), other)
        return docs.select(*carried, said.alias("language"), F.when(said.isNotNull(), 1.0).otherwise(0.0).alias("confidence"), F.lit(None).cast("string").alias("text_language"), said.isNotNull().alias("kept"))
    k = len(languages) + 1  # the last class is none of the languages
    names = F.array(*map(F.lit, languages), F.lit(None).cast("string"))
    scored = address(likelihoods(docs, profiles(docs, languages)))
    scored = written(scored.withColumn("p", _normal(F.col("ll"))), "likelihoods")
    sums = [F.count_if(F.col("letters") > 0).alias("texts"), *(F.sum(F.when(F.col("letters") > 0, F.col("p")[i]).otherwise(0.0)).alias(f"s{i}") for i in range(k))]
    said = lambda by: scored.groupBy(*by).agg(*sums)
    row = lambda r: np.array([r[f"s{i}"] or 0.0 for i in range(k)])
    all_rows = row(scored.agg(*sums).first()) + SMOOTH
    prior = all_rows / all_rows.sum()

    # What a declaration (`said`: the language, or null for any other) or a suffix says of each
    # language: bounded tables, by soft counts.
    known = F.when(F.col("declared").isin(languages), F.col("declared"))
    names_of = {r["said"]: row(r) for r in scored.where("declared is not null").groupBy(known.alias("said")).agg(*sums).collect()}
    spoken = sum(names_of.values()) + SMOOTH * (k + 1)
    table = [(d, [math.log(x) for x in (names_of.get(d, np.zeros(k)) + SMOOTH) / spoken]) for d in [*languages, None]]
    declared = F.broadcast(docs.sparkSession.createDataFrame(table, "said string, declared_ll array<double>"))
    flat = lambda prefix: F.array(*(F.col(f"{prefix}{i}") for i in range(k)))
    suffixes = said(["suffix"]).where("suffix is not null")
    suffixes = suffixes.select("suffix", F.array(*(F.log((F.col(f"s{i}") + F.lit(SMOOTH)) / F.lit(float(all_rows[i] + SMOOTH * 50))) for i in range(k))).alias("suffix_ll"))

    # Priors: all rows, then the domain's, then the host's, each smoothed by the one before.
    domains = said(["domain"]).select("domain", F.array(*((F.col(f"s{i}") + F.lit(float(DOMAIN_WEIGHT * prior[i]))) / (F.col("texts") + F.lit(DOMAIN_WEIGHT)) for i in range(k))).alias("dp"))
    hosts = said(["host", "domain"]).where("host is not null").join(domains, "domain").select("host", *(F.log((F.col(f"s{i}") + HOST_WEIGHT * F.col("dp")[i]) / (F.col("texts") + HOST_WEIGHT)).alias(f"h{i}") for i in range(k))).select("host", flat("h").alias("host_ll"))
    # rows without a host match nothing and needn't meet
    spread = F.coalesce("host", F.concat(F.lit("\0"), F.pmod(F.xxhash64("doc_id", "letters", "ll"), F.lit(997)).cast("string")))
    rows = scored.withColumn("_host", spread).join(small(hosts.withColumnRenamed("host", "_host"), hosts.count(), 50_000), "_host", "left").join(small(suffixes, suffixes.count(), 50_000), "suffix", "left")
    rows = rows.withColumn("known", known).join(declared, F.col("declared").isNotNull() & F.col("known").eqNullSafe(F.col("said")), "left")
    none = F.array(*[F.lit(0.0)] * k)
    start = F.array(*(F.lit(math.log(x)) for x in prior))
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    logs = add(add(F.col("ll"), F.coalesce("declared_ll", none)), add(F.coalesce("host_ll", start), F.coalesce("suffix_ll", none)))
    rows = rows.withColumn("post", _normal(logs))
    best = lambda c: names[F.array_position(c, F.array_max(c)).cast("int") - 1]
    rows = rows.withColumn("language", F.coalesce(best(F.col("post")), F.when(F.col("letters") > 0, other))).withColumn("confidence", F.array_max("post")).withColumn("text_language", F.when(F.col("letters") > 0, best(F.col("p"))))
    return rows.select(*carried, "language", "confidence", "text_language", ((F.col("letters") > 0) & (F.col("confidence") >= keep) & F.col("language").isNotNull()).alias("kept"))


def identify(docs: DataFrame, declared: str = "lang", host: str = "source") -> DataFrame:
    """doc_id, language, confidence, text_language, declared, kept of every text of docs."""
    rows = chosen(docs, doc_id="long", text="string", **{declared: "string", host: "string"}).withColumnsRenamed({declared: "declared", host: "host"})
    return fuse(rows).select("doc_id", "declared", "language", "confidence", "text_language", "kept")


def accepted(docs: DataFrame, declared: str = "lang", host: str = "source") -> DataFrame:
    """The rows of docs that have a language."""
    rows = stowed(docs, doc_id="long", text="string", **{declared: "string", host: "string"}).withColumnsRenamed({declared: "declared", host: "host"})
    rows = rows.withColumn("key1", F.xxhash64("doc_id", "text", "declared", "host")).withColumn("key2", F.xxhash64(F.lit(5), "text"))
    gone = fuse(rows.drop("_row")).where("not kept").select("key1", "key2").distinct()
    gone = written(gone, "rejected")
    return unstowed(rows.join(small(gone, gone.count()), ["key1", "key2"], "left_anti"), docs.columns)
