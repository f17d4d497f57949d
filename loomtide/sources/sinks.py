"""What consumers read: newest snapshots, a ring of events, a record layout."""

from __future__ import annotations

import json
import os
import struct
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the published record.
RING = 32
MAX_BANDS = 8
BAND_BYTES = 40
EVENT_BYTES = 24
RECORD_BYTES = 16384
MODES = {"idle": 0, "energy": 1, "beat": 2}
KINDS = {"low": 0, "mid": 1, "high": 2}
UNKNOWN_KIND = 255
BAND_FIELDS = ("rms", "harmonic_rms", "slow_rms", "slow_harmonic_rms", "onset_density", "density_delta")
SCALARS = ("centroid", "centroid_delta", "centroid_rms", "centroid_harmonic_rms", "slow_centroid_harmonic_rms", "percussiveness", "spectral_novelty", "section_change", "bpm", "effective_bpm", "tempo_confidence")


def latest(snapshots: DataFrame, order: str = "frame", key: str = "track") -> DataFrame:
    """The newest row of each track: an aggregate with a partial step, no sort."""
    rest = [c for c in snapshots.columns if c != key]
    return snapshots.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("s")).select(key, "s.*")


def ring(events: DataFrame, size: int = RING) -> DataFrame:
    """The newest ``size`` events of each track with their slot and kind number."""
    w = Window.partitionBy("track").orderBy(F.desc("seq"))
    known = F.coalesce(*[F.when(F.col("kind") == k, F.lit(i)) for k, i in KINDS.items()], F.lit(UNKNOWN_KIND))
    return events.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= size).drop("__r").withColumn("slot", (F.col("seq") - 1) % size).withColumn("kind_id", known)


def unseen(events: DataFrame, last: int, size: int = RING) -> DataFrame:
    """What a reader that has seen up to ``last`` gets: the newest, at most a ring."""
    w = Window.partitionBy("track").orderBy(F.desc("seq"))
    return events.where(F.col("seq") > last).withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= size).drop("__r")


def changes(df: DataFrame, column: str) -> DataFrame:
    """Rows at which a column differs from the row before, the first included."""
    w = Window.partitionBy("track").orderBy("frame")
    return df.withColumn("__was", F.lag(column).over(w)).where(~F.col(column).eqNullSafe(F.col("__was")) | F.col("__was").isNull() & F.col(column).isNotNull()).drop("__was")


def layout(n_bins: int) -> dict[str, int]:
    """Field -> byte offset; 'total' is the size."""
    sizes = {"seq": 8, "n_bins": 4, "spectrum": 4 * n_bins, "stability": 4 * n_bins, "sustained": 4 * n_bins}
    sizes |= {name: 4 for name in SCALARS}
    sizes |= {"tempo_saturated": 1, "mode": 3, "break_intensity": 4, "n_bands": 4, "bands": MAX_BANDS * BAND_BYTES, "event_head": 4, "event_ring": RING * EVENT_BYTES}
    out, at = {}, 0
    for name, size in sizes.items():
        out[name], at = at, at + size
    if at > RECORD_BYTES:
        raise ValueError(f"{n_bins} bins need {at} bytes; there are {RECORD_BYTES}")
    return out | {"total": at}


def record_schema(n_bins: int, bands: list[str], freqs) -> dict:
    """The layout as JSON-ready values, with the bins' frequencies."""
    at = layout(n_bins)
    kinds = {"seq": "u64", "n_bins": "u32", "tempo_saturated": "u8", "mode": "u8"}
    fields = {n: {"offset": o, "type": kinds.get(n, "f32"), "count": n_bins if n in ("spectrum", "stability", "sustained") else 1} for n, o in at.items() if n not in ("n_bands", "bands", "event_head", "event_ring", "total")}
    return {
        "version": 1, "size": RECORD_BYTES, "n_bins": n_bins, "band_names": list(bands), "bin_freqs": [float(f) for f in freqs], "fields": fields,
        "bands": {"offset": at["bands"], "n_bands_offset": at["n_bands"], "stride": BAND_BYTES, "max_bands": MAX_BANDS, "entry_fields": [{"name": "name", "rel_offset": 0, "type": "char16"}, *({"name": f, "rel_offset": 16 + 4 * i, "type": "f32"} for i, f in enumerate(BAND_FIELDS))]},
        "events": {"head_offset": at["event_head"], "ring_offset": at["event_ring"], "ring_size": RING, "entry_size": EVENT_BYTES, "entry_fields": [{"name": n, "rel_offset": o, "type": t} for n, o, t in (("timestamp_ns", 0, "u64"), ("energy", 8, "f32"), ("kind_id", 12, "u8"), ("event_seq", 16, "u64"))]},
    }


def pack(snapshot: dict, n_bins: int, seq: int) -> bytes:
    """A snapshot as the published record; the sequence number comes last in time."""
    at, out = layout(n_bins), bytearray(RECORD_BYTES)
    struct.pack_into("<I", out, at["n_bins"], n_bins)
    for name in ("spectrum", "stability", "sustained"):
        struct.pack_into(f"<{n_bins}f", out, at[name], *snapshot.get(name, [0.0] * n_bins))
    for name in (*SCALARS, "break_intensity"):
        struct.pack_into("<f", out, at[name], snapshot.get(name, 0.0))
    struct.pack_into("<BB", out, at["tempo_saturated"], bool(snapshot.get("tempo_saturated")), MODES.get(snapshot.get("mode"), 0))
    bands = list(snapshot.get("bands", {}).items())[:MAX_BANDS]
    struct.pack_into("<I", out, at["n_bands"], len(bands))
    for i, (name, values) in enumerate(bands):
        struct.pack_into("<16s6f", out, at["bands"] + i * BAND_BYTES, name.encode()[:16], *(values.get(f, 0.0) for f in BAND_FIELDS))
    struct.pack_into("<Q", out, at["seq"], seq)
    return bytes(out)


def unpack(record: bytes) -> dict:
    n_bins = struct.unpack_from("<I", record, 8)[0]
    at = layout(n_bins)
    out = {"seq": struct.unpack_from("<Q", record, at["seq"])[0]}
    out |= {n: list(struct.unpack_from(f"<{n_bins}f", record, at[n])) for n in ("spectrum", "stability", "sustained")}
    out |= {n: struct.unpack_from("<f", record, at[n])[0] for n in (*SCALARS, "break_intensity")}
    saturated, mode = struct.unpack_from("<BB", record, at["tempo_saturated"])
    out |= {"tempo_saturated": bool(saturated), "mode": {v: k for k, v in MODES.items()}[mode], "bands": {}}
    for i in range(struct.unpack_from("<I", record, at["n_bands"])[0]):
        name, *values = struct.unpack_from("<16s6f", record, at["bands"] + i * BAND_BYTES)
        out["bands"][name.rstrip(b"\0").decode()] = dict(zip(BAND_FIELDS, values))
    return out


def save_level(path: str | Path, slow_rms: float) -> None:
    """Writes the slow level beside the target, then moves it into place."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=path.parent)
    with os.fdopen(handle, "w") as f:
        json.dump({"slow_rms": slow_rms}, f)
    os.replace(name, path)


def load_level(path: str | Path, default: float = 0.1) -> float:
    """The saved level if it is over 0 and at most 10, else the default."""
    try:
        value = float(json.loads(Path(path).read_text())["slow_rms"])
    except (OSError, ValueError, KeyError, TypeError):
        return default
    return value if 0 < value <= 10 else default
