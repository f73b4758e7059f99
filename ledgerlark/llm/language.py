"""Language identification by compression.

For each language a zstandard raw-content dictionary is made of a bounded sample of pieces of labelled texts.
A text is cut into chunks, each is encoded with every dictionary, and the language whose chunks
take the fewest bytes together is the answer. A narrow margin rejects it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from heapq import nsmallest

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: the sample: at most so many distinct pieces a language, from any place in any of its texts, of so many characters
SAMPLE_PIECES, PIECE_CHARS = 192, 1000
CHUNK = 2048
LEVEL = 5
#: second smallest size over smallest, less 1, under which the answer is rejected
NARROW = 0.01
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
_OTHER = re.compile(r"[\W\d_]+")


def plain(text: str) -> bytes:
    """What is encoded: the lower-case words with single blanks, so that signs and capitals don't count."""
    return _OTHER.sub(" ", text.lower()).encode("utf-8", "surrogatepass")


def sample(rows: DataFrame, text: str = "text", lang: str = "lang", pieces: int = SAMPLE_PIECES, size: int = PIECE_CHARS) -> dict[str, list[str]]:
    """Pieces of labelled texts by language: those with the least hashes of all distinct pieces of all its texts.

    So a piece may stand anywhere in a text, and copies count once. Each task keeps the least it has seen and
    sends no more than `pieces` of a language, so a language with most rows is no burden.
    """
    rows = rows.filter(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[str, dict[int, str]] = {}
        bound: dict[str, int] = {}
        for batch in batches:
            for name, value in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                held, value = least.setdefault(name, {}), value.as_py()
                for at in range(0, len(value), size):
                    piece = value[at : at + size]
                    place = xxhash.xxh64_intdigest(piece.encode("utf-8", "surrogatepass")) >> 1
                    if place < bound.get(name, 1 << 63) and _LETTER.search(piece):
                        held[place] = piece
                        if len(held) >= 2 * pieces:
                            kept = nsmallest(pieces, held)
                            least[name] = held = {p: held[p] for p in kept}
                            bound[name] = kept[-1]
        found = [(name, p, held[p]) for name, held in least.items() for p in nsmallest(pieces, held)]
        columns = list(zip(*found, strict=True)) if found else [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())], ["lang", "place", "piece"])

    order = Window.partitionBy("lang").orderBy("place")
    picked = rows.mapInArrow(run, "lang string, place long, piece string").groupBy("lang", "place").agg(F.min("piece").alias("piece"))
    picked = picked.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= pieces)
    found: dict[str, list[str]] = {}
    for row in picked.select("lang", "n", "piece").orderBy("lang", "n").collect():  # at most `pieces` a language
        found.setdefault(row["lang"], []).append(row["piece"])
    return found


class Classifier:
    def __init__(self, texts: dict[str, list[str]]) -> None:
        self.langs = sorted(texts)
        self.encoders = []
        for lang in self.langs:
            data = zstandard.ZstdCompressionDict(b"\n".join(plain(t) for t in texts[lang]), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            data.precompute_compress(level=LEVEL)
            self.encoders.append(zstandard.ZstdCompressor(dict_data=data, write_content_size=False, write_checksum=False))

    def classify(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score and whether the margin is too narrow."""
        if not self.langs or text is None or not _LETTER.search(text):
            return UNKNOWN, 0.0, True
        data = plain(text)
        chunks = [data[i : i + CHUNK] for i in range(0, len(data), CHUNK)]
        sizes = sorted((sum(len(e.compress(c)) for c in chunks), lang) for e, lang in zip(self.encoders, self.langs, strict=True))
        best = sizes[0]
        margin = sizes[1][0] / best[0] - 1 if len(sizes) > 1 else 1.0
        return best[1], margin / (margin + 4 * NARROW), margin < NARROW


def identify(docs: DataFrame, labelled: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", carry: tuple = ()) -> DataFrame:
    """doc_id, lang_pred, score, rejected for every row of docs, and the columns in carry.

    labelled: the rows to learn from (doc_id, text, lang); null languages teach nothing. A text
    that is null, empty or without a letter gets `und`, score 0 and is rejected; so does every text
    if nothing can be learned. Ties go to the first language by code point. Texts are encoded
    whole, repeated rows get equal answers, an empty table gives an empty result.
    """
    texts = sample(labelled, text, lang)
    made: list[Classifier] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not made:
            made.append(Classifier(texts))
        for batch in batches:
            out = [made[0].classify(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64()), pa.array([x[2] for x in out], pa.bool_())],
                [*batch.schema.names[1:], "lang_pred", "score", "rejected"],
            )

    rows = docs.select(F.col(text).alias("_text"), F.col(doc_id).alias("doc_id"), *carry)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    return rows.mapInArrow(run, f"{fields}, lang_pred string, score double, rejected boolean")
