"""Language identification by error-correcting output codes.

Every language has a codeword of +1/-1 bits, far from the others. Per bit one binary
classifier over hashed character n-grams (1 to ``ORDER`` lower-cased code points) votes: a
multinomial naive Bayes on the mean n-gram distributions of the languages at +1 against
those at -1, so a language with many documents does not outweigh the rest. The vote is the
mean log odds per n-gram. Decoding adds up a logistic loss over the bits, weighted by how
well the bit separates the training languages, and takes the codeword of least loss.

Training reads at most about ``PER_LANG`` labelled documents a language, drawn by a hash of
id and text: a documented bound, since the classifier has few parameters. Counts are
summed in Spark; the driver sees (languages x buckets) numbers.

Defined results: a null text or one without a letter is ``und`` with score 0.0, as is
every text if nothing could be learned. Null languages are not learned from. Equal losses
go to the smaller language by code point. ``ambiguous`` marks a runner-up of nearly the
same loss, or more codeword bits wrong than the code can mend. Repeated rows are judged
alike; held_out is false for a null doc_id, which is not learned from either.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stagecraft.llm.shipped import Shipped
from stagecraft.llm.words import batched, mix

ORDER, BUCKETS, PER_LANG = 3, 1 << 13, 2000
UNDETERMINED, CLOSE = "und", 0.02


def grams(text: str, order: int = ORDER, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket of n-grams occurs in the whole text."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"),
                          np.uint32).astype(np.uint64)
    counts = np.zeros(buckets, np.int64)
    rolled = np.zeros(len(codes), np.uint64)
    for n in range(1, order + 1):
        if len(codes) < n:
            break
        rolled = rolled[: len(codes) - n + 1] * np.uint64(0x100000001B3) + codes[n - 1 :]
        at = mix(rolled + np.uint64(n)) % np.uint64(buckets)
        counts += np.bincount(at.astype(np.int64), minlength=buckets)
    return counts


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """``n`` rows of +1/-1: of several random codes the one with the widest least distance."""
    bits = max(7, 6 * max(1, int(np.ceil(np.log2(max(n, 2))))) + 3)
    draw, best, width = np.random.default_rng(seed), None, -1
    for _ in range(200):
        code = draw.choice(np.array([-1, 1], np.int8), size=(n, bits))
        if n > 1:
            code = code[:, (code != code[0]).any(axis=0)]
        code = np.unique(code, axis=1) if n > 1 else code
        apart = min(((code[i] != code[j]).sum() for i in range(n) for j in range(i)), default=bits)
        if apart > width:
            best, width = code, apart
    return best


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray      # languages x bits
    odds: np.ndarray      # buckets x bits: log odds of an n-gram
    weight: np.ndarray    # bits
    scale: float
    can_mend: int

    def losses(self, text: str) -> np.ndarray:
        counts = grams(text, buckets=len(self.odds))
        vote = (counts @ self.odds) / max(1, counts.sum()) * self.scale
        return (np.logaddexp(0, -self.code * vote) * self.weight).sum(axis=1), vote

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if not text or not self.langs or not any(map(str.isalpha, text)):
            return UNDETERMINED, 0.0, True
        losses, vote = self.losses(text)
        order = np.argsort(losses, kind="stable")
        odds = np.exp(losses[order[0]] - losses)
        wrong = int((np.sign(vote) != self.code[order[0]]).sum())
        close = len(order) > 1 and losses[order[1]] - losses[order[0]] < CLOSE * losses.mean()
        return (self.langs[order[0]], float(1.0 / odds.sum()),
                bool(close or wrong > self.can_mend))


def held_out(doc_id) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(labelled: DataFrame, per_lang: int = PER_LANG, buckets: int = BUCKETS) -> Model:
    """Learn from the rows (doc_id, text, lang) given, at most about ``per_lang`` a language."""
    rows = labelled.select("doc_id", "text", F.col("lang").cast("string")).where(
        F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model([], np.zeros((0, 1)), np.zeros((buckets, 1)), np.ones(1), 1.0, 0)
    share = F.create_map(*[F.lit(x) for k, v in sizes.items() for x in (k, min(1.0, per_lang / v))])
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) / float(1 << 20)
    chosen = rows.where(place < F.element_at(share, F.col("lang")))

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist()):
                seen = grams(text, buckets=buckets)
                mean = seen / max(1, seen.sum()) * min(int(seen.sum()), 1000)
                total[lang] = total.get(lang, 0) + mean
        for lang, counts in total.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at)), pa.array(at), pa.array(counts[at])],
                names=["lang", "bucket", "n"])

    found = chosen.select("lang", "text").mapInArrow(
        count, "lang string, bucket bigint, n double").groupBy("lang", "bucket").agg(
        F.sum("n").alias("n")).toPandas()
    langs = sorted(sizes, key=lambda x: x.encode())
    counts = np.zeros((len(langs), buckets))
    counts[[langs.index(x) for x in found["lang"]], found["bucket"].to_numpy()] = (
        found["n"].to_numpy().round(3))
    shares = (counts + 0.1) / (counts + 0.1).sum(axis=1, keepdims=True)
    code = codewords(len(langs))
    odds = np.zeros((buckets, code.shape[1]))
    for b in range(code.shape[1]):
        yes, no = code[:, b] > 0, code[:, b] < 0
        if yes.any() and no.any():
            odds[:, b] = np.log(shares[yes].mean(axis=0)) - np.log(shares[no].mean(axis=0))
    margins = (shares @ odds) * code
    least = margins.min(axis=0).clip(1e-3)
    apart = min(((code[i] != code[j]).sum() for i in range(len(langs)) for j in range(i)),
                default=1)
    return Model(langs, code, odds, least / least.sum() * len(least), 4.0 / float(np.median(least)),
                 max(0, (int(apart) - 1) // 2))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous: one row per input row, in place."""
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()),
                        ("lang_pred", pa.string()), ("score", pa.float64()),
                        ("ambiguous", pa.bool_())])
    shared = Shipped(docs.sparkSession, model)

    def fill(batch):
        for doc_id, out, text in zip(*(batch[c].to_pylist() for c in ("doc_id", "out", "text"))):
            yield doc_id, out, *shared.value.predict(text)

    return docs.select(F.col("doc_id").cast("bigint"), held_out("doc_id").alias("out"), "text"
                       ).mapInArrow(batched(schema, fill), "doc_id bigint, held_out boolean, "
                                    "lang_pred string, score double, ambiguous boolean")


def learnable(docs: DataFrame) -> DataFrame:
    """The rows that may be learned from: those whose id does not hold them out."""
    return docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)


def keep_identified(docs: DataFrame, model: Model) -> DataFrame:
    """Drop the rows without a language: no text, or no letter in it.

    An ambiguous text stays; it has a language, only which one is in doubt.
    """
    shared = Shipped(docs.sparkSession, model)

    def run(batches):
        for batch in batches:
            good = [shared.value.predict(t)[0] != UNDETERMINED for t in batch["text"].to_pylist()]
            yield batch.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
