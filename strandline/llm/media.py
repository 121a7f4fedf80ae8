"""Media columns: payloads stored as lossless WebP and read back."""

from __future__ import annotations

import hashlib
from typing import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm import webp
from strandline.llm.common import SLICE_BYTES, materialize, slices

#: Samples in a row; payloads are filled up to whole rows.
ROW = 192
BLANK = b" "
#: Samples of one image: decoding takes some 150 bytes a sample.
FRAME = ROW * 1024


def to_payload(text: str | None) -> tuple[bytes, int]:
    """The UTF-8 bytes with blanks up to a positive multiple of a row, and their number without."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + BLANK * (max(ROW, -(-len(raw) // ROW) * ROW) - len(raw)), len(raw)


def store(payload: bytes) -> bytes:
    """One or more WebP files, one behind the other; each holds at most FRAME bytes."""
    return store_all([payload])[0]


def store_all(payloads: list[bytes]) -> list[bytes]:
    """The stored bytes of each payload.  Repeats are looked for in the frames
    of all payloads at once, but only within a frame."""
    frames = [(k, p[i : i + FRAME]) for k, p in enumerate(payloads) for i in range(0, len(p), FRAME)]
    out = [b""] * len(payloads)
    at, joined = 0, np.frombuffer(b"".join(f for _, f in frames), np.uint8)
    size, back = webp.repeats(joined, np.repeat(np.arange(len(frames), dtype=np.int32), [len(f) for _, f in frames]))
    for k, f in frames:
        z = at + len(f)
        out[k] += webp.encode_samples(joined[at:z], ROW, (size[at:z], back[at:z]))
        at = z
    return out


def load(media: bytes) -> np.ndarray:
    """The samples of stored bytes."""
    parts, at = [], 0
    while at < len(media):
        end = at + 8 + int.from_bytes(media[at + 4 : at + 8], "little")
        _, _, pixels = webp.decode(media[at:end])
        parts.append(((pixels >> np.uint32(8)) & np.uint32(255)).astype(np.uint8))
        at = end
    return np.concatenate(parts)


def describe(samples: np.ndarray) -> str:
    """Rows, mean, deviation, entropy and the share of the commonest sample, to 4 digits."""
    counts = np.bincount(samples, minlength=256)
    p = counts[counts > 0] / len(samples)
    mean = float(counts @ np.arange(256)) / len(samples)
    spread = max(0.0, float(counts @ np.arange(256) ** 2) / len(samples) - mean * mean) ** 0.5
    return f"rows={len(samples) // ROW};mean={mean:.4f};dev={spread:.4f};entropy={-float((p * np.log2(p)).sum()) + 0.0:.4f};mode={int(counts.argmax())}:{float(p.max()):.4f}"


def store_texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``n_bytes`` and ``media`` (WebP bytes) to every row, in place of
    columns of those names; a null text is empty, long texts take several files."""

    @F.pandas_udf("n_bytes long, media binary")
    def run(column):
        import pandas as pd

        sizes, media, some, held = [], [], [], 0
        for t in column:
            payload, n = to_payload(t)
            sizes.append(n)
            some.append(payload)
            held += len(payload)
            if held >= SLICE_BYTES // 2:
                media += store_all(some)
                some, held = [], 0
        return pd.DataFrame({"n_bytes": sizes, "media": media + store_all(some)})

    kept = [c for c in docs.columns if c not in ("n_bytes", "media")]
    name = next(n for n in ("_m", "_m_", "_m__") if n not in docs.columns)
    stored = docs.withColumn(name, run(F.col(text).cast("string")))
    return stored.select(*[F.col(f"`{c}`") for c in kept], F.col(name)["n_bytes"].alias("n_bytes"), F.col(name)["media"].alias("media"))


def pixel_arrays(media: DataFrame, column: str = "media") -> DataFrame:
    """Add width, height and pixels (ARGB as array<long>) of lossless WebP files.

    A null gives nulls; bytes that are no lossless WebP file raise an error."""

    @F.pandas_udf("width int, height int, pixels array<long>")
    def run(values):
        import pandas as pd

        rows = [(None, None, None) if v is None else webp.decode(bytes(v)) for v in values]
        return pd.DataFrame({"width": pd.array([r[0] for r in rows], "Int32"), "height": pd.array([r[1] for r in rows], "Int32"), "pixels": [None if r[2] is None else r[2].astype(np.int64) for r in rows]})

    return media.withColumn("_p", run(F.col(column))).select("*", "_p.width", "_p.height", "_p.pixels").drop("_p")


def describe_media(media: DataFrame) -> DataFrame:
    """The features of stored payloads (doc_id, n_bytes, media): every file is
    decoded to its pixels, whose green samples are the payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "media"):
            rows = []
            for stored in b.column("media"):
                raw = stored.as_py()
                samples = load(raw)
                back = samples.tobytes()
                rows.append((len(back), hashlib.sha256(back).hexdigest(), crc32(back[-16:]), len(raw), hashlib.sha256(raw).hexdigest(), describe(samples)))
            columns = list(zip(*rows)) or [[]] * 6
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), *(pa.array(c, k) for c, k in zip(columns, kinds))], names)

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)


def round_trip(docs: DataFrame) -> DataFrame:
    """Store every whole text as WebP in a table of the shared folder, read the
    table in another stage and describe what was read.

    Rows of (doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32,
    media_bytes, media_sha256, feature), a row for each row: repeated ones and
    null doc_ids too.  Null texts are empty, very long ones take several files,
    an empty table gives none, and other columns of ``docs`` are not used.
    All but ``n_bytes`` is computed from the bytes read back."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return describe_media(materialize(store_texts(texts).select("doc_id", "n_bytes", "media"), "media", compression="none"))
