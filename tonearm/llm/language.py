"""Language identification in two steps: the family first, then pairs of languages within it.

Texts become counts of character n-grams inside words, hashed into buckets. One linear support
vector machine per family (against the rest) picks the family; within it one machine per pair of
languages votes. Machines are trained in parallel on a bounded sample, one group per machine.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonearm.llm.common import plain_columns, slices

UNKNOWN = "und"
BUCKETS = 1 << 15
ORDERS = (1, 2, 3, 4)
# Labelled rows a language is learned from, about, and all languages together; every language with a
# usable row is learned.
ROWS_PER_LANGUAGE = 600
ROWS_LEARNED = 120_000
# Weights of all machines together, about: with more machines they share fewer buckets, but not below
# the least, so that a model takes 32 MB or 1 KB for each machine.
WEIGHTS, LEAST_BUCKETS = 1 << 23, 256
# Text handled at once, in bytes: every character gives four n-grams of several numbers each.
TEXT_BYTES = 512 << 10
# A letter belongs to a language if it makes at least this share of its letters in the rows learned from.
LETTER_SHARE = 1e-5
# N-gram shares are small numbers; scaled so that the regularisation suits them.
_SCALE = 8.0

# Families of languages by ISO 639-1 code; any other value is its own family.
FAMILIES = {
    "germanic": ["af", "da", "de", "en", "fo", "is", "lb", "nl", "no", "sv", "yi"],
    "romance": ["ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"],
    "slavic": ["be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"],
    "baltic": ["lt", "lv"],
    "celtic": ["br", "cy", "ga", "gd"],
    "uralic": ["et", "fi", "hu"],
    "turkic": ["az", "kk", "ky", "tr", "tt", "ug", "uz"],
    "indic": ["as", "bn", "gu", "hi", "mr", "ne", "pa", "si", "ur"],
    "iranian": ["fa", "ku", "ps", "tg"],
    "semitic": ["am", "ar", "he", "mt"],
    "dravidian": ["kn", "ml", "ta", "te"],
    "austronesian": ["id", "jv", "mg", "ms", "tl"],
}


def family_of(language: str, families: dict[str, list[str]] = FAMILIES) -> str:
    return next((name for name, own in families.items() if language in own), f"only-{language}")


@functools.cache
def _is_letter() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


@dataclass
class _Grams:
    """Buckets of the n-grams of some texts, by order, and the text of each."""

    texts: int
    buckets: list[np.ndarray] = field(default_factory=list)
    owners: list[np.ndarray] = field(default_factory=list)

    def totals(self) -> np.ndarray:
        return sum((np.bincount(o, minlength=self.texts) for o in self.owners),
                   np.zeros(self.texts, np.int64))

    def scores(self, weights: np.ndarray) -> np.ndarray:
        """Sums of the rows of ``weights`` (bucket x machine) over each text's n-grams."""
        out = np.zeros((self.texts, weights.shape[1]))
        for bucket, owner in zip(self.buckets, self.owners):
            if len(owner):
                first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
                out[owner[first]] += np.add.reduceat(
                    weights[bucket], first, axis=0, dtype=np.float64)
        return out


def grams(texts: list[str | None], buckets: int = BUCKETS) -> _Grams:
    """N-grams of lower-cased words with a blank at either end; none reaches across a word."""
    parts = [np.frombuffer((t or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
             for t in texts]
    sizes = np.array([len(p) for p in parts], np.int64)
    blank = np.full(1, 32, np.uint32)
    codes = np.concatenate([blank, *(x for p in parts for x in (p, blank))])
    owner = np.repeat(np.arange(len(texts) + 1), np.r_[1, sizes + 1]) - 1
    letter = _is_letter()[codes]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first blank after a word
    keep[0] = True
    codes, owner, letter = np.where(letter, codes, np.uint32(32))[keep], owner[keep], letter[keep]
    found = _Grams(len(texts))
    mixed = codes * np.uint32(0x9E3779B1)
    for order in ORDERS:
        n = len(codes) - order + 1
        if n < 1:
            continue
        h = np.full(n, order * 0x85EBCA6B % 2**32, np.uint32)
        for k in range(order):
            h = (h ^ mixed[k:k + n]) * np.uint32(0x01000193)
            h ^= h >> np.uint32(15)
        valid = letter[:n].copy() if order == 1 else np.ones(n, bool)
        for k in range(1, order - 1):
            valid &= letter[k:k + n]
        if order == 2:
            valid &= letter[:n] | letter[1:1 + n]
        found.buckets.append((h[valid] % np.uint32(buckets)).astype(np.int32))
        found.owners.append(owner[order - 1:][valid])
    return found


def train_machine(rows: list[tuple[np.ndarray, np.ndarray]], signs: np.ndarray, buckets: int,
                  cost: float = 10.0, epochs: int = 30) -> np.ndarray:
    """Weights (and bias, last) of a linear support vector machine with squared hinge loss, by
    dual coordinate descent over rows in a fixed shuffled order."""
    weights, duals = np.zeros(buckets + 1), np.zeros(len(rows))
    norms = np.array([v @ v + 1.0 for _, v in rows]) + 0.5 / cost
    order = np.random.default_rng(7)
    for _ in range(epochs):
        most = 0.0
        for i in order.permutation(len(rows)):
            at, values = rows[i]
            slope = signs[i] * (weights[at] @ values + weights[-1]) - 1 + duals[i] * 0.5 / cost
            if duals[i] == 0 and slope > 0:
                continue
            most = max(most, abs(slope))
            new = max(duals[i] - slope / norms[i], 0.0)
            step = (new - duals[i]) * signs[i]
            duals[i] = new
            weights[at] += step * values
            weights[-1] += step
        if most < 1e-3:
            break
    return weights


@dataclass
class LanguageModel:
    """Weights by family and by pair of languages of a family, all over the same buckets."""

    families: dict[str, list[str]]
    family_weights: np.ndarray
    family_bias: np.ndarray
    pair_weights: dict[str, np.ndarray]
    pair_bias: dict[str, np.ndarray]
    buckets: int = BUCKETS

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and confidence (0 to 1) of each text."""
        found = grams(texts, self.buckets)
        total = found.totals()
        known = (total > 0) & (len(self.families) > 0)
        out, sure = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
        if not known.any():
            return out.tolist(), sure
        scale = (_SCALE / np.maximum(total, 1))[:, None]
        names = list(self.families)
        margins = found.scores(self.family_weights) * scale + self.family_bias
        best = margins.argmax(axis=1)
        odds = np.exp(2 * (margins - margins.max(axis=1, keepdims=True)))
        sure_family = odds[np.arange(len(texts)), best] / odds.sum(axis=1)
        for k, name in enumerate(names):
            own = np.flatnonzero(known & (best == k))
            languages = self.families[name]
            if not len(own):
                continue
            if len(languages) == 1:
                out[own], sure[own] = languages[0], sure_family[own]
                continue
            pairs = list(combinations(range(len(languages)), 2))
            margin = (found.scores(self.pair_weights[name]) * scale)[own] + self.pair_bias[name]
            votes = np.zeros((len(own), len(languages)))
            belief = np.zeros_like(votes)
            for p, (a, b) in enumerate(pairs):
                first = 1 / (1 + np.exp(-np.clip(2 * margin[:, p], -50, 50)))
                votes[:, a] += first >= 0.5
                votes[:, b] += first < 0.5
                belief[:, a] += first
                belief[:, b] += 1 - first
            belief /= len(languages) - 1
            choice = (votes + belief / 2).argmax(axis=1)  # belief breaks ties of votes
            out[own] = np.array(languages, object)[choice]
            sure[own] = sure_family[own] * belief[np.arange(len(own)), choice]
        return out.tolist(), sure


def held_out(doc_id: str) -> F.Column:
    """Rows that are never learned from: crc32 of the id as text is a multiple of 5."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _labelled(docs: DataFrame, doc_id: str, text: str, lang: str) -> DataFrame:
    return plain_columns(docs, doc_id=doc_id, text=text, lang=lang).where(
        F.col("lang").isNotNull() & ~held_out("doc_id") & F.col("text").rlike(r"\p{L}"))


def _counts(labelled: DataFrame) -> dict[str, int]:
    """Labelled ids of each language."""
    ids = labelled.groupBy("lang", "doc_id").agg(F.lit(1).alias("one"))
    return {r["lang"]: r["n"] for r in ids.groupBy("lang").agg(F.count("*").alias("n")).collect()}


def _sample(labelled: DataFrame, counts: dict[str, int], rows_per_language: int) -> DataFrame:
    """Ids of small hash: of each language the share that makes about ``rows_per_language``, or as many
    as all may have together; all of a language that has fewer."""
    most = max(1, min(rows_per_language, ROWS_LEARNED // max(1, len(counts))))
    draws = 1 << 40
    limits = labelled.sparkSession.createDataFrame(
        [(lang, draws * most // max(most, n)) for lang, n in sorted(counts.items())],
        "lang string, upto bigint")
    ids = labelled.select("lang", "doc_id", _draw(draws))
    # the least id by hash is in, so that no language goes without
    least = ids.groupBy("lang").agg(F.min("draw").alias("least"))
    chosen = ids.join(limits.join(least, "lang"), "lang").where(
        (F.col("draw") < F.col("upto")) | (F.col("draw") == F.col("least")))
    # about ROWS_LEARNED ids, and one for each language; one text for an id, however often it repeats
    return (labelled.join(F.broadcast(chosen.select("lang", "doc_id").distinct()), ["lang", "doc_id"],
                          "left_semi")
            .groupBy("lang", "doc_id").agg(F.min("text").alias("text")))


def _draw(draws: int) -> F.Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(draws)).alias("draw")


def learn(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
          rows_per_language: int = ROWS_PER_LANGUAGE, buckets: int = BUCKETS,
          families: dict[str, list[str]] = FAMILIES) -> LanguageModel:
    """Train on about ``rows_per_language`` labelled rows of each language outside the held-out
    part, those of smallest hash (all, if there are fewer); whole texts count, and texts without letters
    don't. Every language that has such a row is learned. Rows of one id count once, with the least
    of their texts.

    Without any labelled rows the model knows no language and answers ``und``.
    """
    labelled = _labelled(docs, doc_id, text, lang)
    counts = _counts(labelled)
    names: dict[str, list[str]] = {}
    for language in sorted(counts):
        names.setdefault(family_of(language, families), []).append(language)
    if not names:
        return LanguageModel({}, np.zeros((buckets, 0), np.float32), np.zeros(0), {}, {}, buckets)
    sample = _sample(labelled, counts, rows_per_language)
    machines = [("family", name, "") for name in names]
    machines += [("pair", a, b) for own in names.values() for a, b in combinations(own, 2)]
    places = {m: i for i, m in enumerate(machines)}
    while len(machines) * buckets > WEIGHTS and buckets > LEAST_BUCKETS:
        buckets //= 2

    def features(batches):
        for part in slices(batches, "text", TEXT_BYTES):
            texts, languages = part.column("text").to_pylist(), part.column("lang").to_pylist()
            found = grams(texts, buckets)
            every = [np.concatenate([b[np.searchsorted(o, i):np.searchsorted(o, i, "right")]
                                     for b, o in zip(found.buckets, found.owners)] or
                                    [np.zeros(0, np.int32)]) for i in range(len(texts))]
            rows = []
            for language, own in zip(languages, every):
                at, n = np.unique(own, return_counts=True)
                at, n = at.astype("<i4").tobytes(), (n * (_SCALE / max(1, len(own)))).tobytes()
                family = family_of(language, families)
                rows += [(i, 1 if kind == "family" and a == family or
                          kind == "pair" and a == language else -1, at, n)
                         for (kind, a, b), i in places.items()
                         if kind == "family" or language in (a, b)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, kind) for x, kind in zip(
                    zip(*rows), (pa.int32(), pa.int32(), pa.binary(), pa.binary()))],
                names=["machine", "sign", "at", "n"])

    def train(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["at", "n", "sign"], ignore_index=True)
        vectors = [(np.frombuffer(a, "<i4"), np.frombuffer(n)) for a, n in zip(rows["at"], rows["n"])]
        weights = train_machine(vectors, rows["sign"].to_numpy(float), buckets)
        return pd.DataFrame({"machine": [int(rows["machine"][0])],
                             "weights": [weights.astype("<f4").tobytes()]})

    trained = (sample.mapInArrow(features, "machine int, sign int, at binary, n binary")
               .groupBy("machine").applyInPandas(train, "machine int, weights binary"))
    weights = {machines[r["machine"]]: np.frombuffer(r["weights"], "<f4")
               for r in trained.collect()}
    nothing = np.zeros(buckets + 1, np.float32)
    rows = [weights.get(("family", name, ""), nothing) for name in names]
    own = np.stack(rows, axis=1)
    pair_weights, pair_bias = {}, {}
    for name, languages in names.items():
        if len(languages) > 1:
            both = np.stack([weights.get(("pair", a, b), nothing)
                             for a, b in combinations(languages, 2)], axis=1)
            pair_weights[name], pair_bias[name] = both[:-1].copy(), both[-1].astype(float)
    return LanguageModel(names, own[:-1].copy(), own[-1].astype(float), pair_weights, pair_bias,
                         buckets)


def identify(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with ``lang_pred`` and ``score`` (0 to 1), which take the
    place of columns of that name.

    Null texts and texts without a letter are ``und`` with score 0. Only the text is looked at:
    equal texts get equal answers. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(model)  # bounded by WEIGHTS, and LEAST_BUCKETS a machine
    names = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]

    def run(batches):
        for part in slices(batches, text, TEXT_BYTES):
            language, score = known.value.predict(part.column(text).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*(part.column(n) for n in names), pa.array(language, pa.string()),
                 pa.array(score, pa.float64())], names=[*names, "lang_pred", "score"])

    schema = docs.select(*names).schema.add("lang_pred", "string").add("score", "double")
    return docs.select(*names).mapInArrow(run, schema)


def letters_of(docs: DataFrame, model: LanguageModel, doc_id: str = "doc_id", text: str = "text",
               lang: str = "lang", rows_per_language: int = ROWS_PER_LANGUAGE) -> str:
    """The lower-cased letters and marks of the languages learned, from rows like those of ``learn``."""
    if not model.families:
        return ""
    labelled = _labelled(docs, doc_id, text, lang)
    sample = _sample(labelled, _counts(labelled), rows_per_language)
    counted = (sample.select("lang", F.explode(F.regexp_extract_all(
        F.lower("text"), F.lit(r"([\p{L}\p{M}])"), 1)).alias("letter"))
        .groupBy("lang", "letter").agg(F.count("*").alias("n")))
    every = F.sum("n").over(Window.partitionBy("lang"))
    often = counted.withColumn("every", every).where(F.col("n") >= LETTER_SHARE * F.col("every"))
    return "".join(sorted(r["letter"] for r in often.select("letter").distinct().collect()))


def letter_share(text: str, letters: str) -> F.Column:
    """Share of the characters of a text, without blanks, that are among ``letters``."""
    if not letters:
        return F.lit(0.0)
    own = F.char_length(F.regexp_replace(F.lower(text), f"[^{letters}]+", ""))
    return own / F.nullif(F.char_length(F.regexp_replace(text, r"[\s\p{Z}]+", "")), F.lit(0))
