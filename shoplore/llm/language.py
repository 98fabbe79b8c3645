"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. The vector of an n-gram binds (multiplies) the vectors
of its letters, each permuted (rolled) by its place. A profile bundles (adds) the vectors of all
n-grams of a text or a language, and a text goes to the language with the largest cosine.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoplore.llm.common import fold, in_arrow, per_text, pieces


#: N-grams whose vectors are held at once.
BLOCK = 1024


@dataclass(frozen=True)
class Space:
    """Dimensions of the vectors, letters in an n-gram, and the seed of the letters' vectors."""

    dims: int = 2048
    n: int = 3
    seed: int = 7


@cache
def _letter_table():
    """Code point to itself if it is a letter, else to 0."""
    import numpy as np

    return np.array([i if chr(i).isalpha() else 0 for i in range(0x110000)], dtype=np.int64)


@lru_cache(maxsize=16_384)
def _letter(space: Space, code: int):
    import numpy as np

    return np.random.default_rng([space.seed, code]).integers(0, 2, space.dims, dtype=np.int8) * 2 - 1


def _grams(text: str, n: int):
    """Distinct n-grams of the lower-cased letters, runs of other characters counting as one blank, and
    how often each occurs; None for a text without letters."""
    import numpy as np

    codes = _letter_table()[np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype="<u4")]
    codes = np.concatenate([[0], codes, [0]])
    codes = codes[np.concatenate([[True], (codes[1:] != 0) | (codes[:-1] != 0)])]
    if not codes.any():
        return None
    ids = np.zeros(max(len(codes) - n + 1, 1), dtype=np.int64)
    for k in range(n):
        ids = ids << 21 | codes[k:k + len(ids)] if len(codes) >= n else ids
    return np.unique(ids, return_counts=True)


def _bundle(space: Space, counted: list):
    """One profile per row: the sum of the vectors of its n-grams times their weights. N-grams are bound and added
    in blocks, so that memory does not grow with their number."""
    import numpy as np

    every = np.unique(np.concatenate([ids for ids, _ in counted]))
    places = np.searchsorted(every, np.concatenate([ids for ids, _ in counted]))
    order = np.argsort(places, kind="stable")
    rows = np.repeat(np.arange(len(counted)), [len(ids) for ids, _ in counted])[order]
    amounts, places = np.concatenate([amounts for _, amounts in counted])[order], places[order]
    out = np.zeros((len(counted), space.dims), dtype=np.float32)
    for at in range(0, len(every), BLOCK):
        part = every[at:at + BLOCK]
        codes = np.stack([part >> 21 * (space.n - 1 - k) & 0x1FFFFF for k in range(space.n)])
        letters, place = np.unique(codes, return_inverse=True)
        place = place.reshape(codes.shape)
        vectors = np.stack([_letter(space, int(c)) for c in letters])
        bound = np.ones((len(part), space.dims), dtype=np.int8)
        for k in range(space.n):
            bound *= np.roll(vectors, space.n - 1 - k, axis=1)[place[k]]
        a, b = np.searchsorted(places, [at, at + BLOCK])
        weights = np.zeros((len(counted), len(part)), dtype=np.float32)
        weights[rows[a:b], places[a:b] - at] = amounts[a:b]
        out += weights @ bound.astype(np.float32)
    return out


def fit_languages(df: DataFrame, text: str = "text", lang: str = "lang", space: Space = Space()) -> dict[str, list[float]]:
    """Profile of every language in ``lang``, from all rows with a language and a letter.

    Each text weighs the same, whatever its length. A task hands on one vector per language; they are
    added up in the executors. The driver gets one vector of ``dims`` numbers per language.
    """
    rows = df.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")).dropna()
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("profile", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        sums: dict = {}
        for batch in batches:
            for part in pieces(batch):
                by_lang: dict = {}
                for name, body in zip(part.column("lang").to_pylist(), part.column("text").to_pylist()):
                    if (found := _grams(body, space.n)) is not None:
                        by_lang.setdefault(name, []).append((found[0], found[1] / found[1].sum()))
                for name, found in by_lang.items():
                    ids, inverse = np.unique(np.concatenate([i for i, _ in found]), return_inverse=True)
                    weights = np.bincount(inverse, np.concatenate([w for _, w in found]))
                    profile = _bundle(space, [(ids, weights)])[0].astype(np.float64)
                    sums[name] = sums.get(name, 0) + profile
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums)), pa.array([x.tolist() for x in sums.values()], pa.list_(pa.float64()))],
                ["lang", "profile"])

    added = (in_arrow(rows, run, schema).select("lang", F.posexplode("profile").alias("dim", "x"))
             .groupBy("lang", "dim").agg(F.sum("x").alias("x")))
    profiles: dict[str, list[float]] = {}
    for r in added.collect():
        profiles.setdefault(r["lang"], [0.0] * space.dims)[r["dim"]] = r["x"]
    return dict(sorted(profiles.items()))


def identify_languages(df: DataFrame, profiles: dict[str, list[float]], key: str = "doc_id", text: str = "text",
                       space: Space = Space(), pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """``key``, the language whose profile is nearest and the cosine to it, cut to 0..1.

    ``und`` with score 0 for a text that is null or has no letter, or if no language was learned.
    Languages at the same cosine: the first by name. Whole texts are read; rows are judged by
    themselves, so repeated rows and null keys give a row each. No shuffle.
    """
    names = list(profiles)

    def make():
        import numpy as np

        known = np.array([profiles[n] for n in names], dtype=np.float32).reshape(len(names), space.dims)
        known = known / np.maximum(np.linalg.norm(known, axis=1, keepdims=True), 1e-12)

        def work(texts):
            found = [_grams(t, space.n) if t and names else None for t in texts]
            told, scores = ["und"] * len(texts), np.zeros(len(texts))
            rows = [i for i, f in enumerate(found) if f is not None]
            if rows:
                vectors = _bundle(space, [found[i] for i in rows])
                cosines = vectors @ known.T / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
                best = cosines.argmax(axis=1)
                scores[rows] = np.clip(cosines[np.arange(len(rows)), best], 0, 1)
                for i, b in zip(rows, best):
                    told[i] = names[b]
            return [told, scores]

        return work

    return per_text(df, key, text, [T.StructField(pred, T.StringType()), T.StructField(score, T.DoubleType())], make)


def language_predictions(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang",
                         folds: int = 5, held: int = 0, space: Space = Space()) -> DataFrame:
    """Learn from the rows outside the held-out fold, predict all rows.

    The fold is crc32 of the key as text, modulo ``folds``. Rows without a key are neither learned from
    nor held out.
    """
    profiles = fit_languages(df.filter(fold(key, folds) != held), text, lang, space)
    return identify_languages(df, profiles, key, text, space).select(
        key, F.coalesce(fold(key, folds) == held, F.lit(False)).alias("held_out"), "lang_pred", "score")


def known_language(df: DataFrame, profiles: dict[str, list[float]], text: str = "text", least_score: float | None = None,
                   space: Space = Space()) -> DataFrame:
    """The rows whose text has a language: not ``und``, and a cosine of at least ``least_score``; if none is
    given, of four deviations of the cosine of unlike vectors, 4 / sqrt(dims), so that chance decides nothing.

    All columns stay as they are. Without profiles nothing can be told, and every row with a letter stays.
    """
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(f"`{text}`").alias("text"))
    if not profiles:
        return df.filter(F.col(f"`{text}`").rlike(r"\p{L}"))
    least_score = 4 / space.dims ** 0.5 if least_score is None else least_score
    told = identify_languages(packed, profiles, "row", "text", space)
    return (told.filter((F.col("lang_pred") != "und") & (F.col("score") >= least_score))
            .select(*[F.col("row")[c].alias(c) for c in df.columns]))
