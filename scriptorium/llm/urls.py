"""URL filters: domain rules, and for URLs without a rule the likelihood ratio of two character language models.

Rules: (host and its subdomains, path prefix), the longest fitting one decides. The models are variable-order Markov models,
one of accepted and one of rejected URLs, each interpolating orders 0 to ORDER by Witten-Bell smoothing. A URL is rejected
where the difference of its log-likelihoods, by character, passes a threshold set on URLs that training left out.

Training: accepted URLs are all different ones that a rule allows. A rule that blocks a whole domain or
language says nothing of how a URL is written, so its URLs are examples of rejected ones only where a word of LEXICON stands in them,
and else of neither. Beside them stand hosts that are made of that lexicon by a rule, single words and pairs: a prior that weighs as much
as these are many. The models know spellings, not the list, so hosts of other words that are written alike are rejected too. What a rule has
decided by (its own labels and path segments) and locale segments are masked, so that models learn how URLs are written and not the
rules again. The threshold takes the least value that at most FALSE of the accepted URLs left out pass, or the middle between the
classes if that is higher.

The models are a table, a row for each context, counted over all examples; it never stands in one place. Texts to score are dealt out in
chunks of about CHUNK characters, and each chunk is joined with the contexts that occur in it. The threshold's ranks are taken in ranges of
the values. Only sums by range come to the driver.

A URL of whose host the mask leaves nothing is scored by its path; where that is empty too, it is allowed. Null URLs and such without :// have an empty host and path, no rule, and an empty text, which is allowed. Repeated rows each give
their row; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.llm.common import by_batch, handed_on, scratch, written

#: verdict, host, path
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
ORDER, FALSE = 5, 0.01
#: Characters of the texts that are scored together.
CHUNK = 1 << 15

#: Words that hosts are made of which url lists reject everywhere: what is offered, and how.
LEXICON = (
    ("ads", "adult", "bet", "bets", "cams", "casino", "cialis", "clicks", "crack", "dating", "farm", "jackpot", "keygen", "loans", "lottery", "malware", "phishing", "pills", "poker", "porn", "prizes", "replica", "sex", "slots", "spam", "torrents", "tracker", "viagra", "warez", "xxx"),
    ("best", "bonus", "cash", "cheap", "click", "discount", "easy", "fast", "free", "hot", "instant", "link", "live", "lucky", "mega", "money", "online", "payday", "super", "track", "win", "x"),
)


def parts_of(urls: DataFrame) -> DataFrame:
    """urls with host (after the first :// up to /, ?, # or the end, A to Z in lower case) and path; empty without ://."""
    at = F.instr("url", "://")
    rest = F.when(at > 0, F.substring("url", at + 3, F.length("url"))).otherwise("")
    raw = F.regexp_extract(F.coalesce(rest, F.lit("")), r"^[^/?#]*", 0)
    path = F.substring(F.coalesce(rest, F.lit("")), F.length(raw) + 1, F.length("url"))
    lower = F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return urls.withColumns({"host": lower, "path": F.coalesce(F.regexp_extract(path, r"^[^?#]*", 0), F.lit(""))})


def ruled(urls: DataFrame, rules: tuple = RULES) -> DataFrame:
    """urls with host, path, and rule and by_rule of the longest rule that fits (null without)."""
    df = parts_of(urls)
    found, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.endswith(F.col("host"), F.lit("." + host))) & F.startswith("path", F.lit(path))
        found, verdict = F.when(fits, F.lit(host + path)).otherwise(found), F.when(fits, F.lit(what)).otherwise(verdict)
    return df.withColumns({"rule": found, "by_rule": verdict})


def masked(host: str, path: str, rules: tuple = RULES) -> str:
    """What the models read: labels and segments that rules name are left out, digits are one character."""
    named = {x for _, h, p in rules for x in [*h.split("."), *p.strip("/").split("/")]}
    labels = [x for x in host.split(".") if x not in named]
    segments = [x for x in path.split("/") if x and x not in named and not re.fullmatch("[a-z]{2}", x)]
    return re.sub(r"\d+", "0", ".".join(labels) + "/" + "/".join(segments))


def windows(text: str, order: int = ORDER) -> list[str]:
    """Each character of a text, and its end, with the `order` characters before it."""
    padded = "\x02" * order + text + "\x03"
    return [padded[i : i + order + 1] for i in range(len(text) + 1)]


class Markov:
    """Counts of characters after contexts of up to ORDER characters, of texts or as they are given."""

    def __init__(self, texts: Iterable[str] = (), order: int = ORDER, counts: dict[str, dict[str, float]] | None = None):
        self.order = order
        self.counts: dict[str, dict[str, float]] = defaultdict(dict) if counts is None else counts
        for text in texts:
            for gram in windows(text, order):
                for n in range(order + 1):
                    after = self.counts[gram[n:-1]]
                    after[gram[-1]] = after.get(gram[-1], 0) + 1
        self.totals = {c: (sum(a.values()), len(a)) for c, a in self.counts.items()}

    def log_likelihood(self, text: str) -> float:
        """Mean over characters, the end included."""
        padded, total = "\x02" * self.order + text + "\x03", 0.0
        for i in range(self.order, len(padded)):
            p = 1 / 256
            for n in range(self.order + 1):
                if (of := self.totals.get(padded[i - n : i])) is None:
                    break  # nor has any longer context been seen
                p = (self.counts[padded[i - n : i]].get(padded[i], 0.0) + of[1] * p) / (of[0] + of[1])
            total += np.log(p)
        return total / (len(text) + 1)


@dataclass
class Judge:
    """Examples to learn from in place of those of the table, and the share of accepted ones left out that may be rejected."""

    accepted: list[str]
    rejected: list[str]
    false: float = FALSE


def seeded(lexicon: tuple = LEXICON) -> list[str]:
    """Hosts of the lexicon's words as masked() gives them: each alone, and before and after each way it may be offered."""
    goods, ways = lexicon
    pairs = [f"{a}{mark}{b}" for g in goods for w in ways for a, b in ((g, w), (w, g)) for mark in ("-", "")]
    hosts = [f"{before}{w}" for i, w in enumerate([*goods, *pairs]) for before in ("", ("www.", "m.", "blog.")[i % 3])]
    return [f"{h}/{path}" for h in hosts for path in ("0", "0.html")]


def _named(text: str, lexicon: tuple = LEXICON) -> bool:
    """Whether what is offered stands in a URL as a word of its own."""
    return not set(lexicon[0]).isdisjoint(re.split(r"[^a-z]+", text))


_TEXT = T.StructType([T.StructField("text", T.StringType()), T.StructField("yes", T.LongType()), T.StructField("no", T.LongType()), T.StructField("asked", T.BooleanType())])
_GRAM = T.StructType([T.StructField("gram", T.StringType()), T.StructField("yes", T.LongType()), T.StructField("no", T.LongType())])


def texts_of(urls: DataFrame, rules: tuple = RULES, lexicon: tuple = LEXICON, judge: Judge | None = None) -> DataFrame:
    """A row for each different text that the models read: text, of how many different URLs it is an accepted (yes) or rejected (no)
    example, and whether a URL without a rule has it (asked)."""
    learn = judge is None
    pairs = ruled(urls.select("url"), rules).select("host", "path", "by_rule").distinct()

    def work(columns: dict) -> dict:
        texts = [masked(host or "", path or "", rules) for host, path in zip(columns["host"], columns["path"], strict=True)]
        rows = [(t, by, learn and by is not None and _named(t, lexicon)) for t, by in zip(texts, columns["by_rule"], strict=True)]
        return {
            "text": texts, "asked": [by is None and t != "/" for t, by, _ in rows],
            "yes": [int(learn and by == "allow" and not named) for _, by, named in rows], "no": [int(by == "block" and named) for _, by, named in rows],
        }

    given = [(t, 0, 1, False) for t in seeded(lexicon)] if learn else [*((t, 1, 0, False) for t in judge.accepted), *((t, 0, 1, False) for t in judge.rejected)]
    rows = by_batch(pairs, _TEXT, work).union(urls.sparkSession.createDataFrame(given, _TEXT))
    return rows.where("yes + no > 0 OR asked").groupBy("text").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"), F.max("asked").alias("asked"))


def _held() -> Column:
    """Whether a text is left out of training."""
    return F.crc32("text") % 5 == 0


def model(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """Both models, from all examples that training takes: each context of up to `order` characters, and for each character that
    follows it how often it does in accepted (yes) and rejected (no) ones."""

    def work(columns: dict) -> dict:
        yes, no = Counter(), Counter()
        for text, y, n in zip(columns["text"], columns["yes"], columns["no"], strict=True):
            for gram in windows(text, order):
                yes[gram] += y
                no[gram] += n
        return {"gram": list(yes), "yes": list(yes.values()), "no": list(no.values())}

    used = texts.where((F.col("yes") + F.col("no") > 0) & ~_held()).select("text", "yes", "no")
    summed = lambda df: df.groupBy("gram").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    longest = summed(by_batch(used, _GRAM, work, most=CHUNK << 3))
    shorter = F.explode(F.array(*(F.substring("gram", order + 1 - n, n + 1) for n in range(order + 1))))
    context, last = F.expr("left(gram, length(gram) - 1)"), F.expr("right(gram, 1)")
    return summed(longest.select(shorter.alias("gram"), "yes", "no")).groupBy(context.alias("context")).agg(F.collect_list(F.struct(last.alias("c"), "yes", "no")).alias("after"))


def ratios(texts: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """text, yes, no, and the ratio of each text that is asked for or left out of training."""
    wanted = texts.where(F.col("asked") | _held())
    n = max(1, math.ceil((wanted.agg(F.sum(F.length("text") + 1)).first()[0] or 0) / chunk))
    dealt = wanted.select("text", "yes", "no", F.pmod(F.xxhash64("text"), F.lit(n)).alias("chunk"))

    def contexts(rows: pa.Table) -> pa.Table:
        found = {gram[i:-1] for text in rows["text"].to_pylist() for gram in windows(text) for i in range(ORDER + 1)}
        return pa.table({"chunk": pa.array([rows["chunk"][0].as_py()] * len(found), pa.int64()), "context": pa.array(list(found), pa.string())})

    def score(rows: pa.Table, parts: pa.Table) -> pa.Table:
        own = {"yes": {}, "no": {}}
        for context, after in zip(parts["context"].to_pylist(), parts["after"].to_pylist(), strict=True):
            for kind, counts in own.items():
                if seen := {x["c"]: x[kind] for x in after if x[kind]}:
                    counts[context] = seen
        yes, no = Markov(counts=own["yes"]), Markov(counts=own["no"])
        found = [float(no.log_likelihood(t) - yes.log_likelihood(t)) for t in rows["text"].to_pylist()]
        return pa.table({"text": rows["text"], "yes": rows["yes"], "no": rows["no"], "ratio": pa.array(found, pa.float64())})

    needed = dealt.select("chunk", "text").groupBy("chunk").applyInArrow(contexts, "chunk long, context string")
    joined = needed.join(model(texts), "context").select("chunk", "context", "after")
    return dealt.groupBy("chunk").cogroup(joined.groupBy("chunk")).applyInArrow(score, "text string, yes long, no long, ratio double")


def threshold_of(scored: DataFrame, false: float = FALSE) -> float:
    """From all examples that training left out, each as often as it is one; a class without any stands at 0. Ranks are taken in
    ranges of the values: a window sees one of them, the driver a sum for each."""
    spark = scored.sparkSession
    held = scored.where(_held() & (F.col("yes") + F.col("no") > 0)).groupBy("ratio").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    dealt = written(held.repartitionByRange(max(2, int(spark.conf.get("spark.sql.shuffle.partitions"))), "ratio").withColumn("part", F.spark_partition_id()), "url_ranges")
    sums = dealt.groupBy("part").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no")).orderBy("part").collect()

    def at(kind: str, rank: Callable[[int], int]) -> float:
        if not (total := sum(s[kind] for s in sums)):
            return 0.0
        left = rank(total)
        for s in sums:
            if left < s[kind]:
                break
            left -= s[kind]
        upto = dealt.where(F.col("part") == s.part).select("ratio", F.sum(kind).over(W.partitionBy("part").orderBy("ratio")).alias("upto"))
        return upto.where(F.col("upto") > left).agg(F.min("ratio")).first()[0]

    middle = (at("yes", lambda n: n // 2) + at("no", lambda n: n // 2)) / 2
    return max(at("yes", lambda n: min(n - 1, int(n * (1 - false)))), middle)


_JUDGED = T.StructType([T.StructField("page_id", T.LongType()), *(T.StructField(n, T.StringType()) for n in ("host", "path", "rule", "by_rule", "text"))])


def judged(urls: DataFrame, rules: tuple = RULES, lexicon: tuple = LEXICON, judge: Judge | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict and ratio (null where a rule decides, and where the text is empty)."""
    with scratch():
        scored = handed_on(ratios(written(texts_of(urls, rules, lexicon, judge), "url_texts")), "url_ratios")
        threshold = threshold_of(scored, judge.false if judge else FALSE)

    def work(columns: dict) -> dict:
        texts = [None if rule or (text := masked(host or "", path or "", rules)) == "/" else text for host, path, rule in zip(columns["host"], columns["path"], columns["rule"], strict=True)]
        return columns | {"text": texts}

    out = by_batch(ruled(urls.select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "by_rule"), _JUDGED, work)
    # rows without a text are dealt out by a key that no text equals: every text holds a slash
    out = out.withColumn("text", F.coalesce("text", F.xxhash64("page_id", "host", "path").cast("string"))).join(scored.select("text", "ratio"), "text", "left")
    verdict = F.coalesce("by_rule", F.when(F.col("ratio") > F.lit(threshold), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "ratio")
