"""URL filters: listed rules first, mined token combinations for the rest.

Method: association rules.  URLs that listed rules decide are the labelled rows;
Spark's FP-growth mines the combinations of their tokens (host labels, path words
and query keys) with the label.  Rules below a confidence or support are pruned,
as are rules that a shorter one with no less confidence contains.  An inverted
index from each rule's rarest token to the rule matches the other URLs.

The number of combinations would double with each token that always comes with
others, so before mining tokens are reduced without loss: those too rare for any
rule are left out; those that one verdict alone has are rules by themselves, and
pruning would drop all longer ones; and tokens of the same rows are one item, which
any of them stands for when a rule is matched.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandframe.llm._shared import fresh, prepare_python

#: (rule, verdict): host, then the beginning of the path
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
SUPPORT, CONFIDENCE = 0.01, 0.8
DEFAULT = "allow"  #: of a URL that no rule decides


def host_of(url: Column) -> Column:
    """What lies between the first ``://`` and the next ``/``, ``?`` or ``#``, A-Z lower-cased; else empty."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def listed_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, says in sorted(rules, key=lambda r: len(r[0])):  # the longest is asked first
        domain, _, start = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith("/" + start)
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, says).otherwise(verdict)
    return name, verdict


def tokens_of(url: Column, host: Column, path: Column) -> Column:
    """Distinct host labels, path words and query keys, each marked by its kind."""
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    part = lambda c, cut, kind: F.transform(F.filter(F.split(c, cut), lambda x: x != ""), lambda x: F.concat(F.lit(kind), x))
    keys = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("q:"), F.substring_index(x, "=", 1)))
    return F.array_distinct(F.concat(part(host, r"\.", "h:"), part(F.lower(path), r"[^\p{L}]+", "p:"), keys))


@dataclass
class Mined:
    tokens: frozenset  # items: each is the name of a class of tokens
    verdict: str
    confidence: float
    support: float


def _item_of(labelled: DataFrame, support: float) -> tuple[dict[str, str], list[Mined]]:
    """The item of each token that mining needs, and the rules of tokens that one verdict alone has.

    What comes to the driver are tokens in at least ``support`` of the rows: they are
    at most the tokens of an average row over ``support``.
    """
    rows = labelled.count()
    each = labelled.select("label", F.xxhash64("tokens").cast("decimal(38,0)").alias("row"), F.explode(F.array_distinct("tokens")).alias("token"))
    # the sum of the hashes of a token's rows tells sets of rows apart
    counted = each.groupBy("token").agg(F.count("*").alias("n"), F.sum("row").alias("rows"), F.min("label").alias("least"), F.max("label").alias("most"))
    items, pure, named = {}, [], {}
    for r in sorted(counted.where(F.col("n") >= support * rows).collect(), key=lambda r: r["token"]):
        if r["least"] == r["most"]:
            pure.append(Mined(frozenset([r["token"]]), r["least"], 1.0, r["n"] / rows))
            items[r["token"]] = r["token"]
        else:
            items[r["token"]] = named.setdefault((r["n"], r["rows"]), r["token"])
    return items, pure


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> tuple[list[Mined], dict[str, str]]:
    """The pruned association rules of ``labelled(tokens, label)``, and the item that each token counts as.

    What comes to the driver are item combinations in at least ``support`` of the
    rows: their number depends on that share, not on the number of rows.
    """
    if labelled.isEmpty():
        return [], {}
    items, found = _item_of(labelled, support)
    alone = {t for m in found for t in m.tokens}
    mixed = {t: i for t, i in items.items() if t not in alone}
    if mixed:
        def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [[*sorted({mixed[t] for t in tokens if t in mixed}), "=" + label] for tokens, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.string()))], names=["items"])

        model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(labelled.select("tokens", "label").mapInArrow(reduced, "items array<string>"))
        rules = model.associationRules.where(F.element_at("consequent", 1).startswith("=")).collect()
        found += [Mined(frozenset(r["antecedent"]), r["consequent"][0][1:], r["confidence"], r["support"]) for r in rules]
    found.sort(key=lambda m: (len(m.tokens), sorted(m.tokens), m.verdict))
    kept: list[Mined] = []
    holding: dict[str, list[Mined]] = defaultdict(list)
    for m in found:
        if any(k.verdict == m.verdict and k.confidence >= m.confidence and k.tokens <= m.tokens for t in m.tokens for k in holding[t]):
            continue
        kept.append(m)
        for t in m.tokens:
            holding[t].append(m)
    return kept, items


def judged(pages: DataFrame, url: str = "url", rules=RULES, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """Add host, path, rule and verdict, and the mined rule's confidence, to each row.

    The verdict is the listed rule's; else that of the matching mined rule with the
    most confidence, then support, then tokens, a block before an allow; else
    ``allow``.  Null URLs and those without ``://`` have an empty host and path and
    no tokens, so they are allowed.  Rows are judged one by one: repeated rows give
    repeated results.  Columns of these names are replaced.
    """
    prepare_python(pages.sparkSession)
    names = ("host", "path", "rule", "verdict", "confidence")
    rest = [c for c in pages.columns if c not in names]
    raw, marked = fresh(pages, "url_text", "url_tokens")
    u = F.col(raw)
    split = pages.select(*rest, F.col(url).cast("string").alias(raw)).withColumn("host", host_of(u)).withColumn("path", path_of(u))
    name, says = listed_rule(F.col("host"), F.col("path"), rules)
    ruled = split.select("*", name.alias("rule"), says.alias("verdict"), tokens_of(u, F.col("host"), F.col("path")).alias(marked)).drop(raw)
    mined, items = mine(ruled.where("verdict is not null").select(F.col(marked).alias("tokens"), F.col("verdict").alias("label")), support, confidence)
    seen: dict[str, float] = defaultdict(float)
    for m in mined:
        for t in m.tokens:
            seen[t] = max(seen[t], m.support)
    index: dict[str, list[Mined]] = defaultdict(list)
    for m in mined:
        index[min(m.tokens, key=lambda t: (seen[t], t))].append(m)
    schema = T.StructType([*(f for f in ruled.schema.fields if f.name != marked), T.StructField("confidence", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            verdicts, sure = batch.column("verdict").to_pylist(), []
            for k, tokens in enumerate(batch.column(marked).to_pylist()):
                sure.append(None)
                if verdicts[k] is None:
                    own = {items[t] for t in tokens if t in items}
                    fits = [m for t in own for m in index.get(t, ()) if m.tokens <= own]
                    best = max(fits, key=lambda m: (m.confidence, m.support, len(m.tokens), m.verdict == "block"), default=None)
                    verdicts[k] = best.verdict if best else DEFAULT
                    sure[k] = best.confidence if best else None
            columns = [pa.array(verdicts, pa.string()) if n == "verdict" else batch.column(n) for n in schema.names[:-1]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sure, pa.float64())], names=schema.names)

    return ruled.mapInArrow(run, schema)
