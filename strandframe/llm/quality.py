"""Quality rules of documents and of the hosts they come from.

Method: host-level rules.  Each document is measured and each rule's failures are
counted by host.  A host's failure rate is shrunk towards the rate of all hosts
by a beta prior whose mean and strength are fitted to the rates of all hosts, so
a few bad documents do not condemn a small host.  Hosts with a shrunk rate above
``HOST_LIMIT`` in any rule are rejected, and the verdict is joined back.

Everything is DataFrame functions on the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandframe.llm._shared import staged

LEAST_WORDS = 10
MOST_REPEATED = 20  #: per cent of words in repeated windows
HOST_LIMIT = 0.5  #: shrunk share of failing documents from which a host is rejected
WEAKEST, STRONGEST = 1.0, 10_000.0  #: documents that the prior counts as
_BLANK = r"[\x20\x09-\x0D]+"
_MADE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def measured(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns ``keep`` and the measures of each row's whole text.

    n_words, word_chars (code points in words), n_symbols (of ``#*$%&|<>``),
    n_dup_lines (lines with a word that equal an earlier one), n_repeat_words (words
    in five-word windows that the text has twice or more) and base_failed.  A null
    text has no words and fails, as does an empty one.
    """
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    one = docs.select(
        *keep,
        F.filter(F.split(t, _BLANK), lambda w: w != "").alias("__words"),
        F.length(F.translate(t, " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
        F.regexp_count(t, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, " \t\x0b\f\r", "")) > 0).alias("__lines"),
    )
    two = one.select(
        *keep, "word_chars", "n_symbols",
        F.size("__words").cast("long").alias("n_words"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.transform("__words", lambda w: F.xxhash64(w)).alias("__hashes"),
    )

    def window(i: Column) -> Column:
        return F.xxhash64(*(F.col("__hashes")[i + j] for j in range(5)))

    three = two.withColumn(
        "__windows", F.when(F.size("__hashes") >= 5, F.transform(F.sequence(F.lit(0), F.size("__hashes") - 5), window)).otherwise(F.array().cast("array<bigint>"))
    ).drop("__hashes")
    # windows beside their equals, by place; texts without any are spared the sort
    four = three.withColumn(
        "__sorted",
        F.when(F.size(F.array_distinct("__windows")) < F.size("__windows"), F.array_sort(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))),
    ).drop("__windows")

    def repeated(x: Column, k: Column) -> Column:
        s = F.col("__sorted")
        return ((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))

    five = four.withColumn("__at", F.array_sort(F.transform(F.filter("__sorted", repeated), lambda x: x["i"]))).drop("__sorted")
    # each such window covers five words, less those that the next one covers too
    covered = F.aggregate(F.transform("__at", lambda p, k: F.least(F.lit(5), F.coalesce(F.get("__at", k + 1) - p, F.lit(5)))), F.lit(0), lambda a, x: a + x)
    six = five.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return six.withColumn("base_failed", failed).select(*keep, *_MADE)


#: name -> whether a measured document fails
RULES: dict[str, Column | str] = {
    "short": f"n_words < {LEAST_WORDS}",
    "repetitive": f"100 * n_repeat_words > {MOST_REPEATED} * n_words",
    "lines": "5 * n_dup_lines > n_words",
    "symbols": "2 * n_symbols > n_words",
    "lengths": "word_chars > 40 * n_words or word_chars < 2 * n_words",
}


def host_verdicts(measures: DataFrame, host: str) -> DataFrame:
    """(host, host_docs, host_rate, host_ok): the worst shrunk failure rate and the verdict."""
    counts = measures.groupBy(host).agg(F.count("*").cast("double").alias("n"), *(F.sum(F.expr(f"cast({rule} as int)")).cast("double").alias(k) for k, rule in RULES.items()))
    fits = [F.struct((F.sum(k) / F.sum("n")).alias("mean"), (F.sum(F.col(k) * F.col(k) / F.col("n")) / F.sum("n")).alias("square")).alias(k) for k in RULES]
    fit = counts.agg(F.struct(F.sum("n").alias("n"), F.count("*").cast("double").alias("hosts"), *fits).alias("fit")).select("fit").scalar()
    rated = counts.withColumn("__fit", fit)
    for k in RULES:
        mean = F.col(f"__fit.{k}.mean")
        noise = mean * (1 - mean) * F.col("__fit.hosts") / F.col("__fit.n")  # what the hosts would differ by chance
        apart = F.col(f"__fit.{k}.square") - mean * mean - noise
        strength = F.when(apart > 0, F.least(F.greatest(mean * (1 - mean) / apart - 1, F.lit(WEAKEST)), F.lit(STRONGEST))).otherwise(F.lit(STRONGEST))
        rated = rated.withColumn(f"__{k}", (F.col(k) + mean * strength) / (F.col("n") + strength))
    worst = F.greatest(*(f"__{k}" for k in RULES))
    return rated.select(host, F.col("n").cast("long").alias("host_docs"), worst.alias("host_rate"), (worst <= HOST_LIMIT).alias("host_ok"))


def judged(docs: DataFrame, host: str = "source", text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, the measures, host_rate and kept of each row.

    A row is kept when it passes the base rules and its host is not rejected.
    Null hosts are one host.  Repeated rows count and return each for itself; an
    empty table gives an empty result.  The measures go to a table in the shared
    folder, since hosts and rows both need them.
    """
    taken = docs.select(*(F.col(c).alias(f"__k{i}") for i, c in enumerate(keep)), F.col(host).cast("string").alias("__host"), F.col(text).alias("__text"))
    own = tuple(f"__k{i}" for i in range(len(keep)))
    measures = staged(measured(taken, "__text", (*own, "__host")), "measures")
    verdicts = host_verdicts(measures, "__host").withColumn("__key", F.struct(F.col("__host").isNull(), F.coalesce("__host", F.lit("")))).drop("__host")
    out = measures.withColumn("__key", F.struct(F.col("__host").isNull(), F.coalesce("__host", F.lit("")))).join(verdicts, "__key", "left")
    kept = ~F.col("base_failed") & F.coalesce("host_ok", F.lit(True))
    return out.select(*(F.col(o).alias(c) for o, c in zip(own, keep)), *_MADE, "host_docs", "host_rate", kept.alias("kept"))


def passing(docs: DataFrame, host: str = "source", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, columns as they are.

    Rejected rows are named by doc_id, host and a hash of the text, nulls included,
    so that a row of the same doc_id with another text is judged for itself.
    """
    marked = docs.select(F.col("doc_id").alias("__id"), F.col(host).alias("__source"), F.col(text).alias("__body"), F.xxhash64(F.col(text)).alias("__hash"))
    gone = judged(marked, "__source", "__body", ("__id", "__source", "__hash")).where("not kept").select("__id", "__source", "__hash").distinct()
    same = docs["doc_id"].eqNullSafe(gone["__id"]) & docs[host].eqNullSafe(gone["__source"]) & (F.xxhash64(docs[text]) == gone["__hash"])
    return docs.join(gone, same, "left_anti")
