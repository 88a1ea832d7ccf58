"""Quality rules: counts over whole texts, and tokeniser fertility with rejection bands by script.

Base rules: at least 50 words, and at most half of the words in repeated three-word windows. The method then encodes the
words with a public vocabulary that falls back to bytes, and measures characters per token, the share of byte-fallback tokens
and the entropy of the tokens (of log2 of their number). Text in its language needs few tokens a word and no bytes; noise,
encoded data and stuck generators fall outside the band of their script. Inside these wide bands, the quartiles over all
documents of a language (where there is a column lang), script and length give fences for characters per token and entropy,
FENCE times the spread beyond the quartiles: symbols glued to words or put between them fall outside. Copies count once
there. Lengths between those with LEAST_DOCS documents have fences in between; shorter and longer ones have the bands alone.

Null counts as an empty text: no words, rejected by the base rule. Repeated rows each give their row; extra columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
import operator
import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.llm.common import by_batch, handed_on, numbered, scratch, written
from scriptorium.llm.words import MULT, mix, word_hashes

SPACE, SYMBOLS = "\x20\t\n\x0b\x0c\r", "#*$%&|<>"

#: By script: least and most characters per token, most byte-fallback share, least and most relative token entropy.
#: Documents outside are rejected. Scripts with syllable or word signs have few characters a token.
BANDS = {
    "Latin": (1.5, 9.0, 0.20, 0.22, 1.0),
    "Greek": (0.6, 9.0, 0.40, 0.22, 1.0),
    "Cyrillic": (1.0, 9.0, 0.30, 0.22, 1.0),
    "Arabic": (0.5, 9.0, 0.50, 0.22, 1.0),
    "Devanagari": (0.3, 9.0, 0.80, 0.15, 1.0),
    "Han": (0.25, 5.0, 0.90, 0.15, 1.0),
    "Kana": (0.3, 5.0, 0.80, 0.15, 1.0),
    "Hangul": (0.25, 5.0, 0.95, 0.15, 1.0),
    "Other": (0.2, 9.0, 0.98, 0.10, 1.0),
}

#: Fences lie so many spreads (distance of the quartiles, and at least this part of the higher one) beyond the quartiles.
FENCE, LEAST_SPREAD, LEAST_DOCS = 2.0, 0.02, 30
_FENCED = ("chars_per_token", "token_entropy")

#: Ranges of code points by which a text's main script is told.
_SCRIPTS = {
    "Greek": "Ͱ-Ͽ",
    "Cyrillic": "Ѐ-ԯ",
    "Arabic": "؀-ۿݐ-ݿ",
    "Devanagari": "ऀ-ॿ",
    "Han": "㐀-鿿",
    "Kana": "぀-ヿ",
    "Hangul": "가-힯",
}
_BEYOND = re.compile("[^\x00-˿Ḁ-ỿ -⋿]")
_EACH = {name: re.compile(f"[{span}]") for name, span in _SCRIPTS.items()}
_LATIN = re.compile("[A-Za-zª-ɏḀ-ỿ]")


def script(text: str) -> str:
    """The script with the most characters; Latin where no other has any."""
    if not _BEYOND.search(text):
        return "Latin"
    counts = {name: len(found.findall(text)) for name, found in _EACH.items()}
    counts["Latin"] = len(_LATIN.findall(text))
    counts["Other"] = len(_BEYOND.findall(text)) - sum(n for name, n in counts.items() if name != "Latin")
    return max(counts, key=lambda name: (counts[name], name == "Latin"))


def repeated_words(hashed: np.ndarray) -> int:
    """Words that lie in three-word windows found twice or more."""
    if len(hashed) < 4:
        return 0
    with np.errstate(over="ignore"):
        window = mix(mix(hashed[:-2] * MULT + hashed[1:-1]) * MULT + hashed[2:])
    order = np.argsort(window)
    same = window[order][1:] == window[order][:-1]
    twice = np.zeros(len(window), bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    covered = np.zeros(len(hashed), bool)
    for k in range(3):
        covered[k : k + len(window)] |= twice
    return int(covered.sum())


class Fertility:
    """Token ids of words by a sentencepiece model, kept for later texts: word i has the ids from starts[i] on."""

    def __init__(self, path: str, most: int = 150_000):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        is_byte = [self.model.is_byte(i) for i in range(self.model.vocab_size())]
        self.bytes = np.flatnonzero(is_byte)
        self.vocabulary = len(is_byte)
        self.most = most
        self._clear()

    def _clear(self) -> None:
        """Forgets all words."""
        self.index: dict[int, int] = {}
        self.ids = np.empty(1 << 16, np.int32)
        self.starts = np.zeros(1 << 14, np.int64)

    def _learn(self, keys: list[int], words: list[str]) -> None:
        found = self.model.encode(words, num_threads=1)
        at, end = len(self.index), int(self.starts[len(self.index)])
        ends = end + np.cumsum([len(x) for x in found])
        while len(self.starts) <= at + len(words):
            self.starts = np.resize(self.starts, 2 * len(self.starts))
        while len(self.ids) < ends[-1]:
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        self.ids[end : ends[-1]] = np.fromiter(itertools.chain.from_iterable(found), np.int32, int(ends[-1]) - end)
        self.starts[at + 1 : at + 1 + len(words)] = ends
        self.index.update(zip(keys, range(at, at + len(words)), strict=True))

    def of(self, texts: list[tuple[bytes, np.ndarray, np.ndarray, np.ndarray]]) -> list[tuple[int, float, float]]:
        """Tokens, byte share and relative entropy of each text, given as its bytes and word_hashes() of them."""
        if len(self.index) > self.most:
            self._clear()
        bounds = np.cumsum([0, *(len(x[1]) for x in texts)])
        keys, first, back = np.unique(np.concatenate([x[1] for x in texts]), return_index=True, return_inverse=True)
        listed = keys.tolist()
        at = np.fromiter(map(self.index.get, listed, itertools.repeat(-1)), np.int64, len(listed))
        if len(new := np.flatnonzero(at < 0)):
            words = []
            for place, i in zip(first[new].tolist(), (np.searchsorted(bounds, first[new], "right") - 1).tolist(), strict=True):
                data, _, starts, ends = texts[i]
                words.append(data[starts[place - bounds[i]] : ends[place - bounds[i]]].decode())
            at[new] = len(self.index) + np.arange(len(new))
            self._learn(keys[new].tolist(), words)
        begin, size = self.starts[at], self.starts[at + 1] - self.starts[at]
        return [self._of_one(begin[x], size[x]) for x in (back[bounds[i] : bounds[i + 1]] for i in range(len(texts)))]

    def _of_one(self, begin: np.ndarray, size: np.ndarray) -> tuple[int, float, float]:
        total = int(size.sum())
        if not total:
            return 0, 0.0, 0.0
        n = np.bincount(self.ids[np.arange(total) + np.repeat(begin - np.cumsum(size) + size, size)], minlength=self.vocabulary)
        by_byte, n = n[self.bytes].sum(), n[np.flatnonzero(n)]
        # log2(total) - sum of n log2 n / total, of log2(total)
        entropy = 1 - float((n * np.log2(n)).sum()) / total / np.log2(total) if total > 1 else 0.0
        return total, float(by_byte / total), max(0.0, entropy)


#: One for each model that this worker process has met.
_models: dict[str, Fertility] = {}


def fertility(path: str) -> Fertility:
    if path not in _models:
        _models[path] = Fertility(path)
    return _models[path]


def _release() -> None:
    """At the end of a partition: the worker goes on to other work."""
    _models.clear()


def _measured(columns: dict, path: str, bands: dict) -> dict:
    own = fertility(path)
    out: dict[str, list] = {name: [] for name in _MEASURES.names[1:]}
    texts = [t or "" for t in columns["text"]]
    cut = [(data, *word_hashes(data)) for data in (t.encode() for t in texts)]
    for text, (_, hashed, _, _), (tokens, bytes_share, entropy) in zip(texts, cut, own.of(cut), strict=True):
        chars = len(text) - sum(map(text.count, SPACE))
        lines = [x for x in text.split("\n") if x.strip(SPACE)]
        kind = script(text)
        low, high, most_bytes, least, most = bands[kind]
        per = chars / tokens if tokens else 0.0
        repeat = repeated_words(hashed)
        failed = len(hashed) < 50 or 100 * repeat > 50 * len(hashed)
        row = (len(hashed), chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeat, failed, kind, tokens, per, bytes_share, entropy)
        fits = low <= per <= high and bytes_share <= most_bytes and least <= entropy <= most
        for name, value in zip(out, (*row, not failed and fits), strict=True):
            out[name].append(value)
    return columns | out


_MEASURES = T.StructType([T.StructField("doc_id", T.LongType()), *(T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), T.StructField("base_failed", T.BooleanType()), T.StructField("script", T.StringType()), T.StructField("n_tokens", T.LongType()), *(T.StructField(n, T.DoubleType()) for n in ("chars_per_token", "byte_share", "token_entropy")), T.StructField("kept", T.BooleanType())])


def _path(path: str | None) -> str:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    return path


def _judged(rows: DataFrame, text: str, lang: str | None, path: str | None, bands: dict | None) -> DataFrame:
    """rows (columns whose names do not start with _) with _group (the language) and _m (the measures, kept by the bands alone),
    as a table."""
    group = F.coalesce(F.col(lang).cast("string"), F.lit("")) if lang else F.lit("")
    schema = T.StructType([*rows.schema.fields, T.StructField("_group", T.StringType()), T.StructField("_m", T.StructType(_MEASURES.fields[1:]))])
    carry = tuple(c for c in (*rows.columns, "_group") if c != text)
    return written(by_batch(rows.withColumn("_group", group), schema, _nested, text, _path(path), bands or BANDS, carry=carry, done=_release), "measures")


def _nested(columns: dict, text: str, path: str, bands: dict) -> dict:
    found = _measured({"text": columns[text]}, path, bands)
    names = _MEASURES.names[1:]
    return columns | {"_m": [dict(zip(names, row, strict=True)) for row in zip(*(found[n] for n in names), strict=True)]}


def _size(tokens: str) -> Column:
    return F.floor(2 * F.log2(F.greatest(F.col(tokens), F.lit(1)))).cast("int")


def fences(judged: DataFrame) -> DataFrame:
    """_group, script, size and the least and most of each of _FENCED. A few rows for each language and script."""
    seen = judged.where("_m.kept").select("_group", "_m.script", _size("_m.n_tokens").alias("size"), "_m.n_tokens", *(F.col(f"_m.{n}") for n in _FENCED)).distinct()
    each = seen.select("_group", "script", "size", F.explode(F.array(*(F.struct(F.lit(n).alias("measure"), F.round(n, 3).alias("value")) for n in _FENCED))).alias("x")).select("_group", "script", "size", "x.*")
    quartiles = each.groupBy("_group", "script", "size", "measure").agg(F.count("*").alias("n"), F.percentile("value", [0.25, 0.75]).alias("q")).where(F.col("n") >= LEAST_DOCS).collect()
    found: dict[tuple, dict] = {}
    for x in sorted(quartiles, key=lambda x: x["size"]):
        low, high = x.q
        spread = FENCE * max(high - low, LEAST_SPREAD * high)
        found.setdefault((x["_group"], x.script), {}).setdefault(x.measure, []).append((x["size"], low - spread, high + spread))
    rows = []
    for key, held in found.items():
        sizes = sorted(x[0] for x in held[_FENCED[0]])
        for size in range(sizes[0], sizes[-1] + 1):
            rows.append((*key, size, *(float(np.interp(size, sizes, [x[k] for x in held[n]])) for n in _FENCED for k in (1, 2))))
    return judged.sparkSession.createDataFrame(rows, "_group string, script string, size int, " + ", ".join(f"low{i} double, high{i} double" for i in range(len(_FENCED))))


def _fenced(judged: DataFrame) -> DataFrame:
    """judged with _kept, the verdict by bands and fences."""
    known = fences(judged).select(F.struct("_group", "script", "size").alias("_key"), F.struct("*").alias("_fence"))
    inside = [F.col(f"_m.{n}").between(F.col(f"_fence.low{i}"), F.col(f"_fence.high{i}")) for i, n in enumerate(_FENCED)]
    key = F.struct("_group", F.col("_m.script").alias("script"), _size("_m.n_tokens").alias("size"))
    verdict = F.col("_m.kept") & F.coalesce(functools.reduce(operator.and_, inside), F.lit(True))
    return judged.withColumn("_key", key).join(F.broadcast(known), "_key", "left").withColumn("_kept", verdict)


def measures(docs: DataFrame, path: str | None = None, bands: dict | None = None) -> DataFrame:
    """The counts, the fertility measures and the verdict of every document. What is shuffled is the numbers alone."""
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.select("doc_id", "text", lang.alias("lang"))
    with scratch():
        judged = _judged(rows, "text", "lang", path, bands)
        found = _fenced(judged)
        return handed_on(found.select("doc_id", *(F.col("_kept").alias(n) if n == "kept" else F.col(f"_m.{n}") for n in _MEASURES.names[1:])), "quality")


def accepted(docs: DataFrame, path: str | None = None, bands: dict | None = None) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns. Texts are encoded once and stay with their measures, so that
    no join of documents brings verdicts back."""
    rows, named = numbered(docs)
    kept = _fenced(_judged(rows, named["text"], named.get("lang"), path, bands)).where("_kept")
    return kept.select(*rows.columns).toDF(*docs.columns)
