"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model.

The model is of characters, order 4, one for each language, and is trained on the
whole text of all trusted documents. Counts, continuation counts, discounts and
interpolation weights are tables of packed 4-grams, made and joined by Spark.

To score, documents are gathered in blocks; a block asks for each of its distinct
grams once. Requests are joined with the sharded tables order by order, answers
return to their block, and each document sums its own. A document is kept if its
perplexity lies between two quantiles of trusted documents of its language and
size class, widened by a margin, as trusted text scores better than unseen text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import carried, forget, restored, saved, small, text_of

ORDER = 4
BITS = 16
BLOCK_CHARS = 32_000_000
#: Labels and thresholds are broadcast up to so many rows (16 and 40 bytes each), beyond that joined by shuffle.
BROADCAST_ROWS = 500_000
#: The quantiles move out by this share of their distance to the median. On sf0.1, trained on half of the labels, the other
#: half's good and poor documents are kept at 97.0 and 9 % with 0, 98.5 and 12 % with 0.5, 99.1 and 15 % with 1.
LOW, HIGH, MARGIN = 0.005, 0.995, 1.0
#: Size classes with fewer trusted documents than this take the thresholds of their language.
LEAST_TRUSTED = 200
START, OTHER = 1, 0xFFFF

_MASK = [(1 << BITS * n) - 1 for n in range(ORDER + 1)]


def grams(text: str) -> np.ndarray:
    """The packed gram that ends at each character; characters beyond 16 bits are one symbol."""
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    codes = np.concatenate([np.full(ORDER - 1, START, np.uint64), np.where(codes >= OTHER, OTHER, codes).astype(np.uint64)])
    n = len(codes) - ORDER + 1
    out = np.zeros(n, np.uint64)
    for i in range(ORDER):
        out = (out << np.uint64(BITS)) | codes[i : i + n]
    return out.view(np.int64)


def gram_counts(docs: DataFrame) -> DataFrame:
    """Rows (lang, gram, c) over all of ``docs(lang, text)``; counts leave a task summed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list] = {}

        def summed(parts: list) -> tuple[np.ndarray, np.ndarray]:
            found, inverse = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
            return found, np.bincount(inverse.reshape(-1), np.concatenate([c for _, c in parts])).astype(np.int64)

        for pdf in batches:
            for lang, part in pdf.groupby("lang"):
                texts = part["text"].tolist()
                step = 500
                for at in range(0, len(texts), step):
                    own = np.unique(np.concatenate([grams(t) for t in texts[at : at + step]]), return_counts=True)
                    held.setdefault(lang, []).append(own)
                if len(held[lang]) > 8:
                    held[lang] = [summed(held[lang])]
        for lang, parts in held.items():
            found, counts = summed(parts)
            yield pd.DataFrame({"lang": lang, "gram": found, "c": counts})

    counted = docs.mapInPandas(run, "lang string, gram long, c long")
    return counted.groupBy("lang", "gram").agg(F.sum("c").alias("c"))


def _suffix(n: int):
    """The last n - 1 symbols of a gram of n."""
    return F.col("gram").bitwiseAND(F.lit(_MASK[n - 1]))


def train(trusted: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """For orders 1 to 4, written tables (lang, gram, p) of seen grams and (lang, context, weight) of seen contexts.

    p has the lower orders in it; ``weight`` goes to the next lower order where a gram is unseen.
    """
    counts = [saved(gram_counts(trusted), "grams")]
    for n in range(ORDER, 1, -1):
        # how many different symbols stand before a gram of the lower order
        lower = counts[-1].select("lang", _suffix(n).alias("gram")).groupBy("lang", "gram").agg(F.count("*").alias("c"))
        counts.append(saved(lower, "continuations"))
    counts.reverse()
    models: list[tuple[DataFrame, DataFrame]] = []
    for n, table in enumerate(counts, 1):
        times = lambda k: F.count(F.when(F.col("c") == k, 1)).cast("double")
        discounts = table.groupBy("lang").agg(*[times(k).alias(f"n{k}") for k in (1, 2, 3, 4)])
        y = F.col("n1") / F.greatest(F.col("n1") + 2 * F.col("n2"), F.lit(1.0))
        # where a count of counts is 0 the estimate is not defined: fall back to fixed discounts
        sound = (F.col("n1") > 0) & (F.col("n2") > 0) & (F.col("n3") > 0)
        bounded = lambda x, k: F.when(sound, F.least(F.greatest(x, F.lit(0.05)), F.lit(k - 0.05))).otherwise(F.lit(0.75))
        discounts = discounts.select(
            "lang",
            *[bounded(k - (k + 1) * y * F.col(f"n{k + 1}") / F.greatest(F.col(f"n{k}"), F.lit(1.0)), k).alias(f"d{k}") for k in (1, 2, 3)],
        )
        context = F.shiftrightunsigned("gram", BITS)
        discount = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        # one row a language
        cut = table.join(F.broadcast(discounts), "lang").select("lang", "gram", "c", context.alias("context"), discount.alias("d"))
        totals = cut.groupBy("lang", "context").agg(F.sum("c").alias("total"), (F.sum("d") / F.sum("c")).alias("weight"))
        seen = cut.join(totals, ["lang", "context"])
        if n == 1:
            sizes = table.groupBy("lang").agg(F.count("*").alias("symbols"))
            below = 1.0 / (F.col("symbols") + 1)
            seen = seen.join(F.broadcast(sizes), "lang")
            totals = totals.join(F.broadcast(sizes), "lang").withColumn("weight", F.col("weight") * below)
        else:
            lower = models[-1][0].select("lang", F.col("gram").alias("low"), F.col("p").alias("below"))
            seen = seen.withColumn("low", _suffix(n)).join(lower, ["lang", "low"])
            below = F.col("below")
        p = (F.col("c") - F.col("d")) / F.col("total") + F.col("weight") * below
        models.append((saved(seen.select("lang", "gram", p.alias("p")), "seen"), saved(totals.select("lang", "context", "weight"), "contexts")))
    return models


def probabilities(requests: DataFrame, models: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """Rows (lang, gram, p) of distinct requested grams: seen ones by lookup, others by the next lower order."""
    open_, done = requests.select("lang", "gram", F.col("gram").alias("key"), F.lit(1.0).alias("factor")), []
    for n in range(ORDER, 0, -1):
        seen, contexts = models[n - 1]
        hit = open_.join(seen.select("lang", F.col("gram").alias("key"), "p"), ["lang", "key"], "left")
        hit = saved(hit, "lookups")
        done.append(hit.where("p is not null").select("lang", "gram", (F.col("factor") * F.col("p")).alias("p")))
        missed = hit.where("p is null").drop("p").withColumn("context", F.shiftrightunsigned("key", BITS))
        weighted = missed.join(contexts, ["lang", "context"], "left").withColumn("factor", F.col("factor") * F.coalesce("weight", F.lit(1.0)))
        open_ = weighted.select("lang", "gram", F.col("key").bitwiseAND(F.lit(_MASK[n - 1])).alias("key"), "factor")
    # symbols never seen: the weight of order 1 has the uniform share in it; languages never seen stay open
    known = models[0][1].select("lang").distinct()
    done.append(open_.join(known, "lang", "left_semi").select("lang", "gram", F.col("factor").alias("p")))
    result = done[0]
    for more in done[1:]:
        result = result.unionByName(more)
    return result


def _blocks(batches: Iterator[pd.DataFrame]):
    """Rows of a partition in blocks of bounded text; numbers depend on the scan's splits alone."""
    from pyspark import TaskContext

    number, held, size = TaskContext.get().partitionId() << 32, [], 0
    for pdf in batches:
        for at in range(0, len(pdf), 1000):
            part = pdf.iloc[at : at + 1000]
            held.append(part)
            size += int(part["text"].str.len().sum())
            if size >= BLOCK_CHARS:
                yield number, pd.concat(held)
                number, held, size = number + 1, [], 0
    if held:
        yield number, pd.concat(held)


def perplexities(docs: DataFrame, models: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """Rows (id, key, lang, trusted, n, perplexity), one per row of ``docs(id, key, lang, trusted, text)``; ids are strings.

    The perplexity is null for empty text or a language without model.
    """
    carry = ["id", "key", "lang", "trusted"]

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for number, pdf in _blocks(batches):
            for lang, part in pdf.groupby("lang"):
                texts, found = part["text"].tolist(), np.empty(0, np.int64)
                for at in range(0, len(texts), 500):
                    found = np.union1d(found, np.concatenate([grams(t) for t in texts[at : at + 500]]))
                yield pd.DataFrame({"block": number, "lang": lang, "gram": found})

    def bundle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pickle

        import zstandard

        for number, pdf in _blocks(batches):
            rows = pickle.dumps([pdf[c].tolist() for c in (*carry, "text")])
            yield pd.DataFrame({"block": [number], "rows": [zstandard.ZstdCompressor(level=3).compress(rows)]})

    asked = docs.select("lang", "text").mapInPandas(ask, "block long, lang string, gram long")
    distinct = asked.select("lang", "gram").distinct()
    answers = asked.join(probabilities(distinct, models), ["lang", "gram"], "left").select("block", "lang", "gram", F.log("p").cast("float").alias("logp"))

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        import pickle

        import zstandard

        tables = {}
        for lang, part in right.groupby("lang"):
            part = part.sort_values("gram")
            tables[lang] = part["gram"].to_numpy(), part["logp"].to_numpy(np.float64)
        out = []
        for rows in left["rows"]:
            for doc, key, lang, trusted, text in zip(*pickle.loads(zstandard.ZstdDecompressor().decompress(rows)), strict=True):
                wanted = grams(text)
                value = None
                if len(wanted):
                    known, logp = tables.get(lang, (np.empty(0, np.int64), None))
                    at = np.searchsorted(known, wanted)
                    # a block that a task made anew with other rows would ask for other grams
                    if not len(known) or at.max() >= len(known) or (known[at] != wanted).any():
                        raise ValueError("the input of this block has changed between two reads")
                    mean = logp[at].mean()
                    value = None if np.isnan(mean) else float(np.exp(-mean))
                out.append((doc, key, lang, trusted, len(wanted), value))
        return pd.DataFrame(out, columns=[*carry, "n", "perplexity"]).astype({"perplexity": "float64"})

    schema = "id string, key long, lang string, trusted boolean, n long, perplexity double"
    bundles = docs.select(*carry, "text").mapInPandas(bundle, "block long, rows binary")
    return bundles.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(score, schema)


def _labels(labels: DataFrame, id_col: str, quality_col: str) -> DataFrame:
    """Distinct ids whose every label is good."""
    return labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("trusted_id")).agg(F.min(quality_col).alias("q")).where("q = 1").select("trusted_id")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quality_col: str = "quality", low: float = LOW, high: float = HIGH, margin: float = MARGIN) -> DataFrame:
    """Rows (id, key, lang, n, trusted, perplexity, lower, upper, kept), one per document.

    ``key`` is xxhash64(id, lang, text) with null language and text as empty
    strings. Null text is empty, has no perplexity and is kept; so are documents
    of a language without trusted text, a null language being one of its own.
    Repeated rows give a row each and count each. An id with several labels is trusted if
    all are 1. Other columns are ignored; an empty table gives no rows.
    """
    lang, text = F.coalesce(F.col(lang_col).cast("string"), F.lit("")), text_of(text_col)
    good = saved(_labels(labels, id_col, quality_col), "trusted")
    keyed = docs.select(F.col(id_col).alias("own_id"), carried(id_col).alias("id"), keys(id_col, text_col, lang_col).alias("key"), lang.alias("lang"), text.alias("text"))
    keyed = keyed.join(small(good, BROADCAST_ROWS), F.col("own_id") == F.col("trusted_id"), "left").withColumn("trusted", F.col("trusted_id").isNotNull()).drop("own_id", "trusted_id")
    models = train(keyed.where("trusted").select("lang", "text"))
    scored = saved(perplexities(keyed, models), "scores")
    forget(*[table for pair in models for table in pair])
    # short texts vary more: thresholds by language and power of two of the length
    size = F.least(F.floor(F.log2(F.greatest(F.col("n"), F.lit(1)))), F.lit(14)).cast("int")
    scored = scored.withColumn("size", size).withColumn("surprise", F.log("perplexity"))
    known = scored.where("trusted and perplexity is not null")

    def bounds(*by: str) -> DataFrame:
        at = F.percentile_approx("surprise", [low, 0.5, high], 10_000)
        found = known.groupBy(*by).agg(at.alias("q"), F.count("*").alias("support"))
        q = F.col("q")
        return found.select(*by, "support", (q[0] - margin * (q[1] - q[0])).alias("lo"), (q[2] + margin * (q[2] - q[1])).alias("hi"))

    # a few rows for each language: documents of one language never meet in one task for them
    by_size = small(saved(bounds("lang", "size").where(F.col("support") >= LEAST_TRUSTED).drop("support"), "bounds"), BROADCAST_ROWS)
    by_lang = small(saved(bounds("lang").drop("support").withColumnsRenamed({"lo": "lang_lo", "hi": "lang_hi"}), "bounds"), BROADCAST_ROWS)
    judged = scored.join(by_size, ["lang", "size"], "left").join(by_lang, "lang", "left")
    lower, upper = F.coalesce("lo", "lang_lo"), F.coalesce("hi", "lang_hi")
    kept = F.coalesce(F.col("surprise").between(lower, upper), F.lit(True))
    own = restored("id", docs.schema[id_col].dataType).alias(id_col)
    return judged.select(own, "key", "lang", "n", "trusted", "perplexity", F.exp(lower).alias("lower"), F.exp(upper).alias("upper"), kept.alias("kept"))


def keys(id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"):
    return F.xxhash64(F.col(id_col), F.coalesce(F.col(lang_col).cast("string"), F.lit("")), text_of(text_col))


def drop_poor(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with all their columns.

    Nulls, ties, repeated rows and empty texts are treated as by ``classify``; an
    empty table gives no rows.
    """
    lost = classify(docs, labels, id_col, text_col, lang_col).where(~F.col("kept")).select(F.col(id_col).alias("lost_id"), F.col("key").alias("lost_key")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("own_id"), keys(id_col, text_col, lang_col).alias("key"))
    return rows.join(lost, F.expr("key = lost_key and own_id <=> lost_id"), "left_anti").select("row.*")
