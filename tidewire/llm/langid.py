"""Language identification by compression.

Each language has a Zstandard raw-content dictionary made of texts known to be in
it; a text, in lower case and with one space for each run of other characters than
letters, is encoded with each, block by block so that the dictionary serves all of
a long text, and the language with the smallest encoding wins.  A prediction is
rejected when the runner-up's encoding is within ``margin`` of the smallest.

Defined cases: null texts and texts without a letter are ``und`` with score 0;
ties go to the language that sorts first; every label that a row with an id and a text
with letters has is a language, however rare; without labelled rows all is ``und``;
rows that repeat an id count once per label in the fit and are each judged; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import pieces
from tidewire.llm.sampling import class_sample

#: Texts of a language that go into its dictionary, characters of each (one slice, at a place
#: dealt by the id, so that no long text fills the dictionary), and bytes of all.
SAMPLE_PER_LANGUAGE = 400
SLICE_CHARS = 300
DICTIONARY_BYTES = 128 << 10
BLOCK_BYTES = 4 << 10
LEVEL = 3
#: Matches from three bytes on count: most of what tells languages apart is that short.
SHORTEST_MATCH = 3
UNKNOWN = "und"
_OTHER = r"[\W\d_]+"


def letters(text: str) -> bytes:
    """Lower case, with one space for each run of characters that are no letters."""
    return re.sub(_OTHER, " ", text.lower()).encode()


def fit_languages(labelled: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """The raw content of each language's dictionary, from a bounded sample of labelled rows.

    A sampled text gives one slice at a place dealt by its id.
    """
    rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text is not null")
    start = F.pmod(F.xxhash64("id", F.lit(5)), F.greatest(F.lit(1), F.length("text") - SLICE_CHARS)) + 1
    piece = F.substring("text", start.cast("int"), F.lit(SLICE_CHARS))
    got = class_sample(rows, "id", "lang", SAMPLE_PER_LANGUAGE).groupBy("lang", "id").agg(F.min(piece).alias("text")).select("lang", F.xxhash64("id").alias("h"), "text").collect()
    out: dict[str, bytes] = {}
    for lang, _, text in sorted(map(tuple, got)):
        out[lang] = b" ".join([*([out[lang]] if lang in out else []), letters(text)])[:DICTIONARY_BYTES]
    return {k: v for k, v in out.items() if v}


def _blocks(data: bytes) -> Iterator[bytes]:
    """Blocks of about equal sizes, none over BLOCK_BYTES."""
    n = -(-len(data) // BLOCK_BYTES)
    for k in range(n):
        yield data[len(data) * k // n : len(data) * (k + 1) // n]


def _predictor(model: dict[str, bytes], margin: float) -> Callable:
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs = sorted(model)
        encoders = []
        for lang in langs:
            content = zstandard.ZstdCompressionDict(model[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            how = zstandard.ZstdCompressionParameters.from_level(
                LEVEL, source_size=BLOCK_BYTES, dict_size=len(model[lang]), min_match=SHORTEST_MATCH, strategy=zstandard.STRATEGY_GREEDY, write_content_size=0, write_checksum=0, write_dict_id=0
            )
            content.precompute_compress(compression_params=how)
            encoders.append(zstandard.ZstdCompressor(dict_data=content, compression_params=how))
        for batch in batches:
            for part in pieces(batch, "text"):
                pred, score, rejected = [], [], []
                for text in part.column("text").to_pylist():
                    if not langs or text is None or not any(map(str.isalpha, text)):
                        pred.append(UNKNOWN)
                        score.append(0.0)
                        rejected.append(True)
                        continue
                    data = letters(text)
                    sizes = np.zeros(len(langs))
                    for block in _blocks(data):
                        sizes += [len(e.compress(block)) for e in encoders]
                    best = int(np.argmin(sizes))
                    rest = np.delete(sizes, best)
                    odds = np.exp(-np.minimum((sizes - sizes[best]) * 0.5, 50))
                    pred.append(langs[best])
                    score.append(float(1 / odds.sum()))
                    rejected.append(bool(len(rest) and (rest.min() - sizes[best]) < margin * sizes[best]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    return predict


def predict_languages(docs: DataFrame, model: dict[str, bytes], *, id_col: str = "doc_id", text_col: str = "text", margin: float = 0.01) -> DataFrame:
    """doc_id, lang_pred, score, rejected (the margin is narrow, or there is nothing to judge)."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()
    return own.mapInArrow(_predictor(model, margin), f"doc_id {kind}, lang_pred string, score double, rejected boolean")
