"""Language identification with interpolated Kneser-Ney character language models."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tallyloom.llm.common import broadcast, worker_memo

ORDER = 4  # characters of the longest gram; four 16-bit characters fill one 64-bit key
SIGMAS = 4.0  # standard errors that a text may cost more than its language does on average; they matter in short texts
FOLDS = 2  # shares of the learning texts, each judged by a model of the others; workers hold a model a share
BIN = 1e-4  # nats a character to which costs are rounded before they are counted
KEEPS = 0.99  # quantile of what those cost beyond that, as the models of all other texts see them
WIDER, EXTRA = 1.5, 0.25  # so much wider, and so many nats more, is what is still accepted
SLACK = 1.0  # a language with fewer than 50 such texts: the share of its mean that a text may cost beyond it
SPACE = 32


def _letters_of_unicode() -> np.ndarray:
    """Key of every code point: itself in 16 bits for letters, a space for the rest."""
    table = np.full(0x110000, SPACE, np.uint64)
    for code in range(0x110000):
        if chr(code).isalpha():
            table[code] = (code ^ (code >> 16)) & 0xFFFF
    return table


def characters(text: str | None) -> np.ndarray:
    """Letters in lower case, every run of other characters one space; empty without letters."""
    if not text:
        return np.empty(0, np.uint64)
    table = worker_memo("letters", _letters_of_unicode)
    keys = table[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")]
    spaces = keys == SPACE
    first = np.ones(len(keys), bool)
    first[1:] = spaces[:-1]
    keys = keys[~(spaces & first)]
    if len(keys) and keys[-1] != SPACE:
        keys = np.append(keys, np.uint64(SPACE))
    return keys


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The ORDER-gram that ends at each character, text after text, and each text's number of them."""
    padding = np.full(ORDER - 1, SPACE, np.uint64)
    parts, sizes = [], []
    for text in texts:
        keys = characters(text)
        sizes.append(len(keys))
        if len(keys):
            keys = np.concatenate([padding, keys])
            size = len(keys) - ORDER + 1
            code = np.zeros(size, np.uint64)
            for i in range(ORDER):
                code = (code << np.uint64(16)) | keys[i : i + size]
            parts.append(code)
    return (np.concatenate(parts) if parts else np.empty(0, np.uint64)), np.array(sizes, np.int64)


def held_texts(docs: DataFrame) -> DataFrame:
    """(lang, text, place, fold): every learning text; equal texts have one place and so one fold."""
    rows = docs.where("lang is not null and text is not null").select("lang", "text", F.xxhash64("text").alias("place"))
    return rows.withColumn("fold", F.pmod(F.shiftrightunsigned("place", 33), F.lit(FOLDS)).cast("int"))


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, gram, n0, n1, ..): how often each gram occurs in all texts of each language, fold by fold.

    Every task adds up what it reads before anything is shuffled.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, fold), (codes, counts) in totals.items():
                for at in range(0, len(codes), 50_000):
                    part = slice(at, at + 50_000)
                    size = len(codes[part])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * size), pa.array([fold] * size, pa.int32()), pa.array(codes[part].view(np.int64)), pa.array(counts[part])],
                        names=["lang", "fold", "gram", "n"],
                    )

        for batch in batches:
            texts = batch.column("text").to_pylist()
            for key, places in _by_share(batch).items():
                found, _ = grams([texts[i] for i in places])
                codes, counts = np.unique(found, return_counts=True)
                if key in totals:
                    known, had = totals[key]
                    codes, where = np.unique(np.concatenate([known, codes]), return_inverse=True)
                    counts = np.bincount(where, np.concatenate([had, counts])).astype(np.int64)
                totals[key] = codes, counts
            if sum(len(codes) for codes, _ in totals.values()) > 2_000_000:
                yield from out()
                totals.clear()
        yield from out()

    rows = held_texts(docs).select("lang", "fold", "text").mapInArrow(count, "lang string, fold int, gram long, n long")
    return rows.groupBy("lang", "gram").agg(*[F.sum(F.when(F.col("fold") == i, F.col("n")).otherwise(0)).alias(f"n{i}") for i in range(FOLDS)])


def _by_share(batch: pa.RecordBatch) -> dict[tuple[str, int], list[int]]:
    """(lang, fold) -> its rows in the batch."""
    shares: dict[tuple[str, int], list[int]] = {}
    for i, key in enumerate(zip(batch.column("lang").to_pylist(), batch.column("fold").to_pylist(), strict=True)):
        shares.setdefault(key, []).append(i)
    return shares


class Model:
    """Interpolated Kneser-Ney probabilities of one language in sorted arrays.

    The longest grams have their counts; a shorter gram counts the characters
    seen before it. Each order gives (total - discount) / total of its context
    and hands the discounted mass to the next shorter gram; single characters
    hand theirs to a uniform distribution.
    """

    def __init__(self, codes: np.ndarray, counts: np.ndarray) -> None:
        order = np.argsort(codes)
        grams, n = codes[order], counts[order].astype(np.float64)
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        for length in range(ORDER, 0, -1):
            once, twice = np.sum(n == 1), np.sum(n == 2)
            discount = once / (once + 2 * twice) if once else 0.5
            context, where = np.unique(grams >> np.uint64(16), return_inverse=True)
            total = np.bincount(where, n)
            share = np.maximum(n - discount, 0) / total[where]
            rest = 1 - np.bincount(where, share)
            self.levels.append((grams, share, context, np.maximum(rest, 1e-12)))
            mask = np.uint64((1 << (16 * (length - 1))) - 1)
            grams, n = np.unique(grams & mask, return_counts=True)
            n = n.astype(np.float64)
        self.uniform = 1 / (len(self.levels[-1][0]) + 1)
        cost = -np.log(self.probability(codes))
        weight = counts / counts.sum()
        self.mean = float(np.sum(weight * cost))
        self.deviation = float(np.sqrt(np.sum(weight * (cost - self.mean) ** 2)))
        self.slack = SLACK * self.mean

    def probability(self, codes: np.ndarray) -> np.ndarray:
        out = np.full(len(codes), self.uniform)
        for length, (grams, share, context, rest) in zip(range(1, ORDER + 1), reversed(self.levels), strict=True):
            own = codes & np.uint64((1 << (16 * length)) - 1)
            out = _found(grams, share, own, 0.0) + _found(context, rest, own >> np.uint64(16), 1.0) * out
        return out


def _found(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, missing: float) -> np.ndarray:
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], missing)


def _beyond(mean: float, deviation: float, others: Model, texts: list[str]) -> np.ndarray:
    """What each text costs ``others``, which have not seen it, a character beyond ``mean`` and SIGMAS standard errors; nan without letters."""
    out = np.full(len(texts), np.nan)
    found, sizes = grams(texts)
    full = np.flatnonzero(sizes)
    if len(full):
        distinct, where = np.unique(found, return_inverse=True)
        cost = -np.log(others.probability(distinct))[where]
        cost = np.add.reduceat(cost, np.concatenate([[0], np.cumsum(sizes[full])[:-1]])) / sizes[full]
        out[full] = cost - mean - SIGMAS * deviation / np.sqrt(sizes[full])
    return out


def _slack(most: float) -> float:
    return WIDER * max(0.0, most) + EXTRA


def calibrated(model: Model, codes: np.ndarray, counts: np.ndarray, texts: list[str]) -> None:
    """Set the model's slack by ``texts``, some of those it learnt from, as a model of all others sees them."""
    found, sizes = grams(texts)
    if np.count_nonzero(sizes) < 50 or 2 * len(found) > counts.sum():
        return
    own, held = np.unique(found, return_counts=True)
    order = np.argsort(codes)
    rest = counts[order].copy()
    rest[np.searchsorted(codes[order], own)] -= held
    beyond = _beyond(model.mean, model.deviation, Model(codes[order][rest > 0], rest[rest > 0]), texts)
    model.slack = _slack(float(np.quantile(beyond[~np.isnan(beyond)], KEEPS)))


def held_costs(docs: DataFrame, expected: dict[str, Model], others: dict[tuple[str, int], Model]) -> DataFrame:
    """(lang, bin, n): how many different texts of a language cost the model of the other folds how much, in units of BIN."""
    shared = broadcast(docs.sparkSession, ({lang: (m.mean, m.deviation) for lang, m in expected.items()}, others))

    def cost(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        means, models = shared()
        for batch in batches:
            texts, beyond = batch.column("text").to_pylist(), np.full(batch.num_rows, np.nan)
            for (lang, fold), places in _by_share(batch).items():
                if (lang, fold) in models:
                    beyond[places] = _beyond(*means[lang], models[lang, fold], [texts[i] for i in places])
            told = pa.array(~np.isnan(beyond))
            bins = pa.array(np.round(np.nan_to_num(beyond) / BIN).astype(np.int64))
            rows = pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("place"), bins], names=["lang", "place", "bin"])
            yield rows.filter(told)

    rows = held_texts(docs).mapInArrow(cost, f"lang {dict(docs.dtypes)['lang']}, place long, bin long")
    return rows.dropDuplicates(["lang", "place"]).groupBy("lang", "bin").agg(F.count("*").alias("n"))


def fit(docs: DataFrame) -> dict[str, Model]:
    """One model per language of ``docs`` (text, lang), from all its rows and all their grams.

    The driver receives a row for each distinct gram of a language, not for
    each place where it occurs. The model's rejection is calibrated by all
    learning texts: what each costs a model of the other folds shows what to
    expect of new texts. Of that the driver receives rounded costs and how
    many texts have them. A language of fewer than 50 different texts keeps
    its slack.
    """
    table = gram_counts(docs).toPandas()
    models, others = {}, {}
    for lang, own in sorted(table.groupby("lang"), key=lambda x: x[0]):
        codes, folds = own["gram"].to_numpy().view(np.uint64), [own[f"n{i}"].to_numpy() for i in range(FOLDS)]
        counts = sum(folds)
        models[lang] = Model(codes, counts)
        for fold, held in enumerate(folds):
            rest = counts - held
            if held.any() and rest.any():
                others[lang, fold] = Model(codes[rest > 0], rest[rest > 0])
    costs = held_costs(docs, models, others).toPandas()
    for lang, own in costs.sort_values("bin").groupby("lang"):
        upto = own["n"].cumsum().to_numpy()
        if upto[-1] >= 50:
            models[lang].slack = _slack(float(own["bin"].to_numpy()[np.searchsorted(upto, KEEPS * upto[-1])]) * BIN)
    return models


def _costs(models: dict[str, Model], name: str, codes: np.ndarray) -> np.ndarray:
    """Nats per distinct gram (row) and language (column); what a worker has met is kept."""
    memo = worker_memo("costs", dict)
    known, costs = memo.get(name, (np.empty(0, np.uint64), np.empty((0, len(models)), np.float32)))
    fresh = np.setdiff1d(codes, known, assume_unique=True)
    if len(fresh):
        new = np.stack([-np.log(model.probability(fresh)) for model in models.values()], axis=1).astype(np.float32)
        if len(known) + len(fresh) > 1_000_000:
            known, costs = known[:0], costs[:0]
            fresh = codes
            new = np.stack([-np.log(model.probability(fresh)) for model in models.values()], axis=1).astype(np.float32)
        known, costs = np.concatenate([known, fresh]), np.concatenate([costs, new])
        order = np.argsort(known)
        known, costs = known[order], costs[order]
        memo.clear()
        memo[name] = known, costs
    return costs[np.searchsorted(known, codes)]


def predict(models: dict[str, Model], texts: list[str | None], name: str) -> pd.DataFrame:
    """lang_pred, score, cross_entropy and rejected of each text.

    ``lang_pred`` has the lowest cross-entropy a character (ties: the first
    name), ``und`` without letters or models. ``score`` is the share of that
    language when each cross-entropy counts over at most 32 characters.
    ``rejected``: no letters, or a cross-entropy above the language's own mean
    by more than SIGMAS standard errors and the slack it was calibrated with.
    """
    names = list(models)
    codes, sizes = grams(texts)
    out = pd.DataFrame({"lang_pred": "und", "score": 0.0, "cross_entropy": None, "rejected": True}, index=range(len(texts)))
    out["cross_entropy"] = out["cross_entropy"].astype("float64")
    full = np.flatnonzero(sizes)
    if not names or not len(full):
        return out
    distinct, where = np.unique(codes, return_inverse=True)
    costs = _costs(models, name, distinct)
    starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
    means = np.stack([np.add.reduceat(costs[:, i][where].astype(np.float64), starts) for i in range(len(names))], axis=1)
    means /= sizes[full][:, None]
    best = means.argmin(axis=1)
    lowest = means[np.arange(len(full)), best]
    evidence = np.exp(-(means - lowest[:, None]) * np.minimum(sizes[full], 32)[:, None])
    most = np.array([m.mean + m.slack for m in models.values()])[best]
    deviation = np.array([m.deviation for m in models.values()])[best]
    out.loc[full, "lang_pred"] = np.array(names, object)[best]
    out.loc[full, "score"] = 1 / evidence.sum(axis=1)
    out.loc[full, "cross_entropy"] = lowest
    out.loc[full, "rejected"] = lowest > most + SIGMAS * deviation / np.sqrt(sizes[full])
    return out


def identified(models: dict[str, Model], docs: DataFrame) -> Column:
    """A struct column (lang_pred, score, cross_entropy, rejected) for the column ``text`` of ``docs``."""
    shared, name = broadcast(docs.sparkSession, models), uuid.uuid4().hex

    @pandas_udf("lang_pred string, score double, cross_entropy double, rejected boolean")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = shared()
        for texts in batches:
            yield predict(known, list(texts), name)

    return of(F.col("text"))


def keep_identified(docs: DataFrame, models: dict[str, Model]) -> DataFrame:
    """The rows of ``docs`` whose text has a language; rejected ones go. Columns are unchanged.

    Null and empty texts and texts without letters have none. Repeated rows
    are judged alike; an empty table stays empty.
    """
    return docs.withColumn("__lang", identified(models, docs)).where("not __lang.rejected").select(*docs.columns)
