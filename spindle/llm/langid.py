"""Language identification by compression: per-language zstandard dictionaries of raw text.

A text is brought to lower case, runs of other characters than letters become one space, and it is encoded with each
language's dictionary, in units that cover it whole (short ones, so that the dictionary and not the text's own repeats
decides). The language with the smallest total wins. The margin to the runner-up, relative to the runner-up's size, is the confidence; narrow
margins are rejected. Dictionaries are built from a bounded sample of the labelled training rows: per
language, DICT_PIECES pieces (distinct texts of a hash range, those with the smallest hash). A piece is the text, or where that is
longer than PIECE characters its letters, or where these are longer too, windows spread evenly over all of them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spindle.llm.common import per_worker, table

DICT_PIECES = 300  # sample bound: training rows per language
PIECE = 1500  # sample bound: characters of each, in WINDOWS parts
WINDOWS = 4
RANGE = 1 << 30
MAX_LANGUAGES = 200  # dictionaries are fixed-size, so the model is bounded by this; more labels are an error
UNIT = 512  # bytes encoded at a time
LEVEL = 6
MARGIN = 0.005  # rejection: (second - best) / second below this
FULL = 0.05  # margin at which the score is about 0.63
UNKNOWN = "und"


_NOT_LETTERS = regex.compile(r"[^\p{L}\p{M}]+")


def normal(text: str) -> bytes:
    return _NOT_LETTERS.sub(" ", text.lower()).encode()


def _piece(text: str) -> Column:
    """The text; of long ones the letters, runs of others one space; where these are long too, WINDOWS windows from the first letters
    to the last."""
    letters = F.trim(F.regexp_replace(F.col(text), r"[^\p{L}\p{M}]+", " "))
    size = PIECE // WINDOWS
    start = lambda i: (1 + F.floor((F.length(letters) - size) * i / (WINDOWS - 1))).cast("int")
    return F.when(F.length(text) <= PIECE, F.col(text)).when(F.length(letters) <= PIECE, letters).otherwise(
        F.concat_ws(" ", *(F.substring(letters, start(i), F.lit(size)) for i in range(WINDOWS))))


def sample(train: DataFrame, text: str = "text", lang: str = "lang") -> list[tuple[str, str]]:
    """(language, piece) rows of the bounded sample, at most DICT_PIECES of about PIECE characters per language.

    Rows without text, letters or language are no training rows; repeated texts count once, also in the size of the hash range, so a
    language with DICT_PIECES distinct texts has so many pieces however often any is copied. ``ValueError`` above MAX_LANGUAGES labels."""
    lettered = train.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(
        F.col(lang).alias("lang"), F.xxhash64(text).alias("h"), _piece(text).alias("piece"))
    counts = lettered.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).limit(MAX_LANGUAGES + 1).collect()
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    # a hash range that holds a few times as many distinct texts as are needed, then the first of these
    share = {r.lang: min(RANGE, RANGE * 4 * DICT_PIECES // max(r.n, 1)) for r in counts}
    out: list[tuple[str, str]] = []
    while share:
        ranges = F.create_map(*(F.lit(x) for kv in sorted(share.items()) for x in kv))
        rows = lettered.where(F.pmod("h", F.lit(RANGE)) < ranges[F.col("lang")])
        pick = rows.groupBy("lang", "h").agg(F.min("piece").alias("piece")).withColumn(
            "k", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("k") <= DICT_PIECES)
        found: dict[str, list[str]] = {}
        for r in pick.collect():
            found.setdefault(r.lang, []).append(r.piece)
        # a language that came out short although its range is not the whole one is read again with a wider one
        short = {la: v for la, v in share.items() if v < RANGE and len(found.get(la, [])) < DICT_PIECES}
        out += [(la, p) for la, v in found.items() if la not in short for p in v]
        share = {la: min(RANGE, max(v, 1) * 16) for la, v in short.items()}
    return sorted(out, key=lambda r: (r[0], _NOT_LETTERS.sub(" ", r[1]).strip(), r[1]))


def dictionaries(pieces: list[tuple[str, str]]) -> dict[str, bytes]:
    out: dict[str, bytes] = {}
    for la, p in pieces:
        out[la] = out.get(la, b"") + normal(p).strip() + b"\n"
    return out


class Classifier:
    def __init__(self, dicts: dict[str, bytes]):
        import zstandard as z

        self.languages = sorted(dicts)
        self.encoders = []
        for la in self.languages:
            d = z.ZstdCompressionDict(dicts[la], dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.encoders.append(z.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_dict_id=False))

    def sizes(self, text: str) -> np.ndarray:
        data = normal(text)
        units = [data[a:a + UNIT] for a in range(0, len(data), UNIT)]
        return np.array([sum(len(e.compress(u)) for u in units) for e in self.encoders], np.int64)

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """Language, margin, score. ``und`` and 0 without letters; ties go to the first name."""
        if not text or not any(map(str.isalpha, text)) or not self.languages:
            return UNKNOWN, 0.0, 0.0
        sizes = self.sizes(text)
        order = np.argsort(sizes, kind="stable")
        best = self.languages[order[0]]
        if len(order) == 1:
            return best, 1.0, 1.0
        second = float(sizes[order[1]])
        margin = (second - float(sizes[order[0]])) / second
        return best, margin, float(-np.expm1(-margin / FULL))


def identify(df: DataFrame, dicts: dict[str, bytes], text: str = "text", margin: float = MARGIN) -> DataFrame:
    """The columns of ``df`` with ``lang_pred``, ``margin``, ``score`` (0 to 1) and ``rejected`` (unknown or narrow).

    NULL, empty and letterless texts are ``und`` with score 0 and rejected. Only ``text`` is read, whole.
    ``ValueError`` if a result column is there already."""
    if clash := {"lang_pred", "margin", "score", "rejected"} & set(df.columns):
        raise ValueError(f"the input already has {sorted(clash)}")
    shipped = df.sparkSession.sparkContext.broadcast(dicts)  # at most MAX_LANGUAGES * DICT_PIECES * PIECE characters

    def run(batches):
        import pyarrow as pa

        for b in batches:
            key = hashlib.md5(repr(sorted((k, hashlib.md5(v).hexdigest()) for k, v in shipped.value.items())).encode()).hexdigest()
            model = per_worker(f"lang-{key}", lambda: Classifier(shipped.value))
            out = [model.predict(t.as_py()) for t in b.column(text)]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64()),
                 pa.array([x[2] for x in out], pa.float64()),
                 pa.array([x[0] == UNKNOWN or x[1] < margin for x in out], pa.bool_())],
                names=[*b.schema.names, "lang_pred", "margin", "score", "rejected"])

    schema = df.withColumns({"lang_pred": F.lit("").cast("string"), "margin": F.lit(0.0), "score": F.lit(0.0),
                             "rejected": F.lit(False)}).schema
    return df.mapInArrow(run, schema)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn(
        "held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)))
    dicts = dictionaries(sample(docs.where("NOT held_out")))
    return identify(docs.select("doc_id", "held_out", "text"), dicts).select(
        "doc_id", "held_out", "lang_pred", "score", "margin", "rejected")
