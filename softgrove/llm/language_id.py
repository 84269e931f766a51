"""Language identification by compression.

For each language a zstandard *raw-content dictionary* is made from texts of
that language. A text is encoded with every language's dictionary; the one
that gives the fewest bytes is the prediction, and a narrow margin to the
runner-up, in proportion to these bytes, rejects it.

Texts are lower-cased and all but letters become spaces, then encoded in
stretches of ``STRETCH`` characters, each on its own: within one long frame
the text itself would soon be a better dictionary than the language's.

Learning uses a bounded sample: of each language at most ``SAMPLE_BYTES`` of
text, at most ``TEXT_BYTES`` from one text, chosen by a hash of the text.
Prediction reads whole texts and is a plain map over the documents; only the
dictionaries (languages x SAMPLE_BYTES) are broadcast.

Edge cases: a NULL text, or one without a letter, is ``und`` with score 0
and rejected; so is every text if nothing was learned. Rows whose label is
NULL aren't learned from. Ties go to the language with more text to learn from
(then to the one that sorts first), and are rejected. Repeated rows give repeated rows; an empty table gives an empty
result; other columns are passed by.
"""

from __future__ import annotations

import re

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType

from softgrove.llm.common import add_fields, steps

SAMPLE_BYTES = 48 << 10
TEXT_BYTES = 4 << 10
STRETCH = 4096
#: Lazy parsing with matches from three bytes on: texts share short syllables
#: with their language's dictionary before they share words.
PARAMETERS = dict(window_log=18, hash_log=17, chain_log=17, search_log=4, min_match=3, target_length=256,
                  strategy=zstandard.STRATEGY_LAZY, write_content_size=False, write_checksum=False, write_dict_id=False)
#: Part of the best encoding by which the runner-up has to be longer, one byte
#: at least. Nearly all held-out texts of a learned language have 0.07 and more;
#: most texts of an unlearned language are under it.
MARGIN = 0.02
UNKNOWN = "und"

_OTHER = re.compile(r"[\W\d_]+")


def letters(text: str | None) -> str:
    """The text in lower case with all but letters turned into spaces."""
    out = _OTHER.sub(" ", (text or "").lower()).strip()
    # \w also holds numerals such as superscripts
    return out if any(map(str.isalpha, out[:64])) or any(map(str.isalpha, out)) else ""


def learn(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", sample_bytes: int = SAMPLE_BYTES,
          text_bytes: int = TEXT_BYTES) -> dict[str, bytes]:
    """Dictionary content of each language, from a bounded sample."""
    rows = labelled.select(F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").alias("text"))
    rows = rows.where("lang IS NOT NULL AND length(text) > 0")
    sizes = rows.groupBy("lang").agg(F.sum(F.least(F.octet_length("text"), F.lit(text_bytes))).alias("size"))
    sizes = {r.lang: r["size"] for r in sizes.collect()}
    if not sizes:
        return {}
    # twice the bytes wanted, so that copies and chance leave enough
    share = F.create_map(*[F.lit(x) for n, size in sizes.items() for x in (n, min(1.0, 2 * sample_bytes / size))])
    picked = (rows.withColumn("order", F.xxhash64("text", F.lit(0)))
              .where((F.pmod("order", F.lit(1 << 30)) / float(1 << 30)) < F.element_at(share, F.col("lang")))
              .select("lang", "order", F.substring("text", 1, text_bytes).alias("text")).distinct())
    content = dict.fromkeys(sorted(sizes, key=lambda n: (-sizes[n], n)), b"")
    for r in sorted(picked.collect(), key=lambda r: (r.lang, r.order, r.text)):
        had = content[r.lang]
        if len(had) < sample_bytes and (text := letters(r.text)):
            content[r.lang] = (had + text.encode()[:text_bytes] + b" ")[:sample_bytes]
    return {n: c for n, c in content.items() if c}


class Classifier:
    """Encodes texts with each language's dictionary."""

    def __init__(self, content: dict[str, bytes]):
        self.names = list(content)
        self.encoders = []
        for name in self.names:
            raw = zstandard.ZstdCompressionDict(content[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            how = zstandard.ZstdCompressionParameters(**PARAMETERS)
            raw.precompute_compress(compression_params=how)
            self.encoders.append(zstandard.ZstdCompressor(dict_data=raw, compression_params=how))

    def sizes(self, text: str) -> list[int]:
        """Encoded bytes of a prepared text under each language."""
        parts = [text[k:k + STRETCH].encode() for k in range(0, len(text), STRETCH)]
        return [sum(len(e.compress(p)) for p in parts) for e in self.encoders]

    def predict(self, text: str | None, margin: float = MARGIN) -> tuple[str, float, bool]:
        """(language, score, rejected)."""
        plain = letters(text)
        if not plain or not self.names:
            return UNKNOWN, 0.0, True
        sizes = self.sizes(f" {plain} ")
        best = min(range(len(sizes)), key=lambda k: (sizes[k], k))
        rest = [s - sizes[best] for k, s in enumerate(sizes) if k != best]
        score = 1 / (1 + sum(2.0 ** -min(d, 1000) for d in rest))
        return self.names[best], score, bool(rest) and min(rest) < max(1, margin * sizes[best])


def identify(documents: DataFrame, content: dict[str, bytes], text_col: str = "text", keep: list[str] | None = None,
             margin: float = MARGIN, prefix: str = "") -> DataFrame:
    """Columns ``keep`` (default: all) and, their names starting with
    ``prefix``: lang_pred, score and rejected."""
    spark = documents.sparkSession
    keep = documents.columns if keep is None else keep
    new = [f"{prefix}{c}" for c in ("lang_pred", "score", "rejected")]
    if {c.lower() for c in new} & {c.lower() for c in keep}:
        raise ValueError(f"the documents have a column named like one of {new}; give a prefix")
    sent = spark.sparkContext.broadcast(content)

    def run(batches):
        model = Classifier(sent.value)
        for batch in batches:
            for part in steps(batch, text_col):
                found = [model.predict(t, margin) for t in part.column(text_col).to_pylist()]
                arrays = [pa.array([x[k] for x in found], t) for k, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *arrays], names=[*keep, *new])

    df = documents.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, text_col])])
    schema = documents.select(*[F.col(f"`{c}`") for c in keep]).schema
    return df.mapInArrow(run, add_fields(schema, list(zip(new, (StringType(), DoubleType(), BooleanType())))))


def keep_identified(documents: DataFrame, content: dict[str, bytes], text_col: str = "text", margin: float = MARGIN) -> DataFrame:
    """The documents (all columns) whose language isn't rejected."""
    mark = "_lang"
    while any(c.lower().startswith(mark) for c in documents.columns):
        mark += "_"
    out = identify(documents, content, text_col, margin=margin, prefix=mark)
    return out.where(f"NOT `{mark}rejected`").select(*[F.col(f"`{c}`") for c in documents.columns])
