"""Telephony audio as a binary column: WAV with mu-law, A-law or IMA ADPCM, decoded and resampled with numpy."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged, text_of, trimmed

BLOCK = 576  # bytes of an ADPCM block, and what payloads are padded to
RATE, WIDE = 8000, 16000
LEVEL = 9  # of compression of the tables, which are kept
#: WAV format tags of the three codecs.
TAGS = {"mulaw": 7, "alaw": 6, "ima_adpcm": 17}
CODECS = tuple(TAGS)
#: Coded bytes of a stored piece: whole blocks, about a MB.
PIECE = BLOCK * 1820
#: Bytes of PCM of one codec that leave a task together: samples of one codec resemble each other, and a page of the table holds a run of them.
RUN = 16 << 20
#: Characters of a text that place it among the others.
OPENING = 64
PCM_COLUMNS = ["row", "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "codec", "rate", "piece", "pcm"]
#: The IMA ADPCM step sizes and index changes.
STEPS = np.array(
    [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767],
    np.int32,
)
INDEX_MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)


def mulaw_table() -> np.ndarray:
    code = ~np.arange(256) & 255
    size = (((code & 15) << 3) + 132 << (code >> 4 & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    code = np.arange(256) ^ 0x55
    segment, size = code >> 4 & 7, (code & 15) << 4
    size = np.where(segment == 0, size + 8, (size + 264) << np.maximum(segment - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """blocks: uint8 of shape (n, BLOCK). int16 samples, one row for each block; one step handles a nibble of every block."""
    n = len(blocks)
    value = blocks[:, 0].astype(np.int32) | blocks[:, 1].astype(np.int32) << 8
    value = np.where(value >= 32768, value - 65536, value)
    index = np.minimum(blocks[:, 2], 88).astype(np.int32)
    data = np.ascontiguousarray(blocks[:, 4:].T)
    out = np.empty((1 + 2 * len(data), n), np.int16)
    out[0] = value
    for k in range(2 * len(data)):
        nibble = (data[k >> 1] >> 4 if k & 1 else data[k >> 1] & 15).astype(np.int32)
        step = STEPS[index]
        move = (step >> 3) + (step >> 2) * (nibble & 1) + (step >> 1) * (nibble >> 1 & 1) + step * (nibble >> 2 & 1)
        value = np.clip(np.where(nibble & 8, value - move, value + move), -32768, 32767)
        index = np.clip(index + INDEX_MOVES[nibble & 7], 0, 88)
        out[k + 1] = value
    return np.ascontiguousarray(out.T)


def midpoints(pcm: np.ndarray) -> np.ndarray:
    """A sample between each one and the next, by an eight-tap half-band filter in integers. Silence beyond the ends."""
    taps = np.array([-5, 49, -245, 1225, 1225, -245, 49, -5], np.int64)  # Lagrange's midpoint weights over 2048
    wide = np.zeros(len(pcm) + 8, np.int64)
    wide[3 : 3 + len(pcm)] = pcm
    between = sum(t * wide[k : k + len(pcm)] for k, t in enumerate(taps))
    return np.clip((between + 1024) >> 11, -32768, 32767).astype(np.int16)


def resampled(pcm: np.ndarray) -> np.ndarray:
    """8 kHz to 16 kHz: each sample, then one between it and the next."""
    out = np.empty(2 * len(pcm), np.int16)
    out[0::2] = pcm
    out[1::2] = midpoints(pcm)
    return out


def to_wav(payload: bytes, codec: str) -> bytes:
    """payload: the coded bytes, a multiple of BLOCK."""
    align, samples = (BLOCK, len(payload) // BLOCK * (2 * (BLOCK - 4) + 1)) if codec == "ima_adpcm" else (1, len(payload))
    extra = struct.pack("<HH", 2, 2 * (BLOCK - 4) + 1) if codec == "ima_adpcm" else struct.pack("<H", 0)
    speed = RATE * align // (2 * (BLOCK - 4) + 1) if codec == "ima_adpcm" else RATE
    fmt = struct.pack("<HHIIHH", TAGS[codec], 1, RATE, speed, align, 4 if codec == "ima_adpcm" else 8) + extra
    body = b"WAVE" + b"".join(name + struct.pack("<I", len(x)) + x for name, x in ((b"fmt ", fmt), (b"fact", struct.pack("<I", samples)), (b"data", payload)))
    return b"RIFF" + struct.pack("<I", len(body)) + body


def from_wav(media: bytes) -> tuple[str, bytes]:
    """(codec, coded bytes)"""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, found = 12, {}
    while at + 8 <= len(media):
        (size,) = struct.unpack_from("<I", media, at + 4)
        found[media[at : at + 4]] = media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    (tag,) = struct.unpack_from("<H", found[b"fmt "])
    return next(c for c, t in TAGS.items() if t == tag), found[b"data"]


def padded(text: str) -> bytes:
    data = text.encode("utf-8", "surrogatepass")
    return data + b"\xff" * (max(1, -(-len(data) // BLOCK)) * BLOCK - len(data))


def stored_audio(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text's bytes as the coded samples of a WAV; its checksum picks mu-law, A-law or ADPCM.

    Null counts as the empty text, which becomes one block of 255s. Repeated rows and null ids are kept; a text of
    any length is one value. Columns other than doc_id and text are not read.
    """

    def store(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            payloads = [padded(t) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_bytes": [len(t.encode("utf-8", "surrogatepass")) for t in batch["text"]], "media": [to_wav(p, CODECS[zlib.crc32(p) % 3]) for p in payloads]})

    return docs.select("doc_id", text_of().alias("text")).mapInPandas(trimmed(store), "doc_id long, n_bytes long, media binary")


def decoded(parts: list[tuple[str, bytes]]) -> Iterator[np.ndarray]:
    """PCM at 8 kHz of each (codec, coded bytes); ADPCM blocks of all of them are decoded together, a few MB at a time."""
    mulaw, alaw = mulaw_table(), alaw_table()
    at = 0
    while at < len(parts):
        to, n = at, 0
        while to < len(parts) and (to == at or n + len(parts[to][1]) < 4 << 20):
            n += len(parts[to][1])
            to += 1
        blocks = [np.frombuffer(p, np.uint8).reshape(-1, BLOCK) for c, p in parts[at:to] if c == "ima_adpcm"]
        adpcm = decode_adpcm(np.concatenate(blocks)) if blocks else np.empty((0, 0), np.int16)
        row = 0
        for codec, payload in parts[at:to]:
            if codec == "ima_adpcm":
                n = len(payload) // BLOCK
                yield adpcm[row : row + n].reshape(-1)
                row += n
            else:
                yield (mulaw if codec == "mulaw" else alaw)[np.frombuffer(payload, np.uint8)]
        at = to


def pieces(codec: str, payload: bytes, piece_bytes: int) -> Iterator[tuple[str, bytes, int, int]]:
    """(codec, coded bytes, samples before the piece, its samples) for pieces of a payload. A piece comes with a block on either side, for the filter."""
    each = 2 * (BLOCK - 4) + 1 if codec == "ima_adpcm" else BLOCK
    for k in range(0, len(payload), piece_bytes):
        left = min(k, BLOCK)
        yield codec, payload[k - left : k + piece_bytes + BLOCK], left // BLOCK * each, len(payload[k : k + piece_bytes]) // BLOCK * each


def resampled_audio(media: DataFrame, piece_bytes: int = PIECE) -> DataFrame:
    """The WAVs of stored_audio() as 16-bit PCM at 16 kHz (little-endian samples, as they are): a row for each piece of piece_bytes coded bytes.

    With each: the number of its WAV's row and its own, doc_id, n_bytes, the sizes and checksums of payload and WAV, codec and rate. No value and no batch grows
    with a text's length. Rows are numbered by task, so write the result before rows are put together again. A task gives runs of rows of one codec, of RUN bytes or what is
    left: the same samples take less room than in the order of the WAVs.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            for row in batch.itertuples():
                codec, payload = from_wav(row.media)
                about = (number, row.doc_id, row.n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(row.media), hashlib.sha256(row.media).hexdigest(), codec, WIDE)
                number += 1
                for k, piece in enumerate(pieces(codec, payload, piece_bytes)):
                    yield about, k, piece

    def together(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting, held = {c: [] for c in CODECS}, dict.fromkeys(CODECS, 0)

        def emptied(codec: str) -> pd.DataFrame:
            rows = []
            for (about, k, (_, _, before, size)), pcm in zip(waiting[codec], decoded([(p[0], p[1]) for _, _, p in waiting[codec]]), strict=True):
                rows.append((*about, k, resampled(pcm)[2 * before : 2 * (before + size)].astype("<i2").tobytes()))
            waiting[codec], held[codec] = [], 0
            return pd.DataFrame(rows, columns=PCM_COLUMNS)

        for one in run(batches):
            codec, _, _, size = one[2]
            waiting[codec].append(one)
            held[codec] += 4 * size
            if held[codec] >= RUN:
                yield emptied(codec)
        for codec in CODECS:
            if waiting[codec]:
                yield emptied(codec)

    return media.mapInPandas(trimmed(together), "row long, doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, codec string, rate int, piece int, pcm binary")


def described(pcm: DataFrame) -> DataFrame:
    """(doc_id, sizes, checksums, feature) of each WAV in a written resampled_audio(): codec, rate, samples, peak, mean square, sign changes and checksum of its PCM.

    A piece is described by itself; the pieces of a WAV, a few numbers each, are put together in order. The checksum is the PCM's CRC-32; of several pieces that of their CRCs as
    joined hexadecimal digits.
    """
    kept = PCM_COLUMNS[:-2]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for stored in batch["pcm"]:
                wide = np.frombuffer(stored, "<i2")
                loud = wide.astype(np.int64)
                rows.append((len(wide), int(np.abs(loud).max()), int(loud @ loud), int(np.count_nonzero((wide[1:] < 0) != (wide[:-1] < 0))), bool(wide[0] < 0), bool(wide[-1] < 0), f"{zlib.crc32(stored):08x}"))
            yield pd.concat([batch[[*kept, "piece"]].reset_index(drop=True), pd.DataFrame(rows, columns=["samples", "peak", "power", "turns", "opens", "ends", "crc"])], axis=1)

    own = pcm.mapInPandas(trimmed(run), "row long, doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, codec string, rate int, piece int, samples long, peak long, power long, turns long, opens boolean, ends boolean, crc string")
    whole = own.groupBy(*kept).agg(F.sum("samples").alias("samples"), F.max("peak").alias("peak"), F.sum("power").alias("power"), F.sum("turns").alias("turns"), F.array_sort(F.collect_list(F.struct("piece", "opens", "ends", "crc"))).alias("pieces"))
    border = lambda k: F.when(F.col("pieces")[k]["opens"] != F.col("pieces")[k - 1]["ends"], 1).otherwise(0)
    borders = F.when(F.size("pieces") > 1, F.aggregate(F.transform(F.sequence(F.lit(1), F.size("pieces") - 1), border), F.lit(0), lambda n, v: n + v)).otherwise(0)
    joined = F.array_join(F.transform("pieces", lambda p: p["crc"]), "")
    crc = F.when(F.size("pieces") > 1, F.lpad(F.lower(F.hex(F.crc32(F.encode(joined, "UTF-8")))), 8, "0")).otherwise(joined)
    feature = F.format_string("%s/%d: samples=%d peak=%d power=%d crossings=%d crc=%s", "codec", "rate", "samples", "peak", F.floor(F.expr("power div samples")), F.col("turns") + borders, crc)
    return whole.select(*kept[1:-2], feature.alias("feature"))


def alike_together(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of every row, in an order by how texts open: copies and texts that begin alike lie side by side, so the tables take less room.

    Copies are in the order of their ids, so a large group of them spreads over tasks. The order is of what rows hold, not of where they came from: a task that runs again deals
    them out as before.
    """
    order = ["opening", "digest", "doc_id"]
    rows = docs.select("doc_id", text_of().alias("text")).withColumns({"opening": F.substring("text", 1, OPENING), "digest": F.xxhash64("text")})
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")


def op8_media(docs: DataFrame) -> DataFrame:
    """Stores the WAVs as a table in the shared folder, reads them back, stores their resampled PCM as another, and describes what is read from that."""
    return described(staged(resampled_audio(staged(stored_audio(alike_together(docs)), "media", LEVEL)), "pcm", LEVEL))
