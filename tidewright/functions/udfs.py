"""Arrow-batched UDFs around ``codec`` for what SQL expressions can't do over whole byte strings."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.functions import codec

# Types are built here, not parsed: this module is also imported where no session is.
STRING, BINARY, LONG, INT, U64 = T.StringType(), T.BinaryType(), T.LongType(), T.IntegerType(), T.DecimalType(20, 0)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


@F.pandas_udf(STRING)
def fnv1a64_hex(data: pd.Series) -> pd.Series:
    """16 hexadecimal digits of the hash of bytes; null for null."""
    some = data.notna()
    out = pd.Series([None] * len(data), dtype=object)
    out[some.to_numpy()] = [f"{int(h):016x}" for h in codec.fnv1a64_many([bytes(x) for x in data[some]])]
    return out


@F.pandas_udf(BINARY)
def varint_bytes(value: pd.Series) -> pd.Series:
    return value.map(lambda v: None if pd.isna(v) else codec.varint(int(v)))


def delta_bytes(kind: str, chunk: int = 1024, max_gap: int = 0):
    """A UDF (old, new) -> payload of one kind; null without an old state or where lengths don't allow the kind."""

    @F.pandas_udf(BINARY)
    def run(old: pd.Series, new: pd.Series) -> pd.Series:
        fits = lambda a, b: a is not None and b is not None and (kind in ("splice", "chunks") or len(a) == len(b))
        return pd.Series([codec.encode_delta(kind, a, b, chunk, max_gap) if fits(a, b) else None for a, b in zip(old, new, strict=True)], dtype=object)

    return run


@F.pandas_udf(BINARY)
def legacy_sparse(old: pd.Series, new: pd.Series) -> pd.Series:
    """The old sparse form; null without an old state or where lengths differ."""
    fits = lambda a, b: a is not None and b is not None and len(a) == len(b)
    return pd.Series([codec.legacy_sparse(a, b) if fits(a, b) else None for a, b in zip(old, new, strict=True)], dtype=object)


@F.pandas_udf(_struct(state=BINARY, error=STRING))
def apply_legacy_sparse(base: pd.Series, payload: pd.Series) -> pd.DataFrame:
    """The new state, or the error's kind; null for a null payload."""
    rows = []
    for b, p in zip(base, payload, strict=True):
        try:
            rows.append((None if p is None else codec.apply_legacy_sparse(b or b"", p), None))
        except codec.CodecError as e:
            rows.append((None, e.kind))
    return pd.DataFrame(rows, columns=["state", "error"])


CANDIDATE_LENGTHS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("rank", T.IntegerType()), T.StructField("len", T.LongType())]))


def candidate_lengths(chunk: int = 1024, max_gap: int = 0):
    """A UDF (old, new) -> every candidate's kind, rank among equals and payload length."""

    def lengths(old: pd.Series, new: pd.Series) -> pd.Series:
        rows = []
        for a, b in zip(old, new, strict=True):
            rows.append([] if a is None or b is None else [{"kind": k, "rank": codec.CODES[k], "len": len(p)} for k, p in codec.candidates(a, b, chunk, max_gap).items()])
        return pd.Series(rows, dtype=object)

    return F.pandas_udf(lengths, CANDIDATE_LENGTHS)


@F.pandas_udf(CANDIDATE_LENGTHS)
def listed_lengths(old: pd.Series, new: pd.Series, kinds: pd.Series) -> pd.Series:
    """Payload lengths of the listed kinds alone, ranked in the list's order; none without an old state."""
    rows = []
    for a, b, ks in zip(old, new, kinds, strict=True):
        rows.append([] if a is None or b is None or ks is None else [{"kind": k, "rank": i, "len": len(codec.encode_delta(k, a, b))} for i, k in enumerate(ks, 1)])
    return pd.Series(rows, dtype=object)


@F.pandas_udf(_struct(previous_len=LONG, current_len=LONG, changed_bytes=LONG, changed_runs=LONG, common_prefix=LONG, common_suffix=LONG))
def change_profile(old: pd.Series, new: pd.Series) -> pd.DataFrame:
    import numpy as np

    rows = []
    for a, b in zip(old, new, strict=True):
        if a is None or b is None:
            rows.append((None,) * 6)
            continue
        n = min(len(a), len(b))
        x, y = np.frombuffer(a, np.uint8)[:n], np.frombuffer(b, np.uint8)[:n]
        differ = x != y
        runs = int(differ[0]) + int((differ[1:] & ~differ[:-1]).sum()) if n else 0
        rows.append((len(a), len(b), int(differ.sum()) + abs(len(a) - len(b)), runs, *codec.affixes(a, b)))
    return pd.DataFrame(rows, columns=["previous_len", "current_len", "changed_bytes", "changed_runs", "common_prefix", "common_suffix"])


@F.pandas_udf(_struct(state=BINARY, error=STRING))
def apply_delta(base: pd.Series, payload: pd.Series) -> pd.DataFrame:
    """The new state, or the error's kind."""
    rows = []
    for b, p in zip(base, payload, strict=True):
        try:
            rows.append((codec.apply_delta(b or b"", p or b""), None))
        except codec.CodecError as e:
            rows.append((None, e.kind))
    return pd.DataFrame(rows, columns=["state", "error"])


@F.pandas_udf(BINARY)
def encode_packet(kind: pd.Series, sequence: pd.Series, base_sequence: pd.Series, base_hash: pd.Series, schema_hash: pd.Series, payload: pd.Series) -> pd.Series:
    """Wire bytes of packets; hashes come as hexadecimal digits."""
    rows = zip(kind, sequence, base_sequence, base_hash, schema_hash, payload, strict=True)
    return pd.Series([codec.encode_packet(codec.Packet(k, int(s), int(b), int(bh, 16), int(sh, 16), bytes(p))) for k, s, b, bh, sh, p in rows], dtype=object)


@F.pandas_udf(_struct(kind=STRING, flags=INT, version=INT, sequence=U64, base_sequence=U64, base_hash=STRING, schema_hash=STRING, payload=BINARY, error=STRING))
def decode_packet(wire: pd.Series) -> pd.DataFrame:
    """Packet fields, or the error's kind."""
    from decimal import Decimal

    rows = []
    for w in wire:
        try:
            p = codec.decode_packet(bytes(w or b""))
            rows.append((p.kind, p.flags, p.version, Decimal(p.sequence), Decimal(p.base_sequence), f"{p.base_hash:016x}", f"{p.schema_hash:016x}", p.payload, None))
        except codec.CodecError as e:
            rows.append((None, None, None, None, None, None, None, None, e.kind))
    return pd.DataFrame(rows, columns=["kind", "flags", "version", "sequence", "base_sequence", "base_hash", "schema_hash", "payload", "error"])


def zstd_payload_at(level: int = 1, min_savings: int = 8):
    """A UDF payload -> the payload compressed where that saves more than ``min_savings`` bytes, else null."""

    def run(payload: pd.Series) -> pd.Series:
        out = []
        for p in payload:
            c = codec.zstd_candidate(codec.Packet("snapshot", 0, 0, 0, 0, bytes(p or b"")), level, min_savings)
            out.append(c.payload if c.compressed else None)
        return pd.Series(out, dtype=object)

    return F.pandas_udf(run, BINARY)


zstd_payload = zstd_payload_at()


def packet_error(cap: int = codec.MAX_PAYLOAD):
    """A UDF wire -> the kind of error that a decoder with that cap on payloads gives, or null."""

    def run(wire: pd.Series) -> pd.Series:
        out = []
        for w in wire:
            try:
                codec.logical_payload(codec.decode_packet(bytes(w or b""), cap), cap)
                out.append(None)
            except codec.CodecError as e:
                out.append(e.kind)
        return pd.Series(out, dtype=object)

    return F.pandas_udf(run, STRING)


@F.pandas_udf(BINARY)
def record_bytes(record: pd.DataFrame) -> pd.Series:
    """A record's bytes, from a struct of its fields."""
    return pd.Series([codec.encode_record(_plain(r)) for r in record.to_dict("records")], dtype=object)


@F.pandas_udf(BINARY)
def record_delta_bytes(old: pd.DataFrame, new: pd.DataFrame) -> pd.Series:
    """Bytes of what changed between two records; null where there is none before."""
    pairs = zip(old.to_dict("records"), new.to_dict("records"), strict=True)
    return pd.Series([None if pd.isna(a["agent_id"]) else codec.encode_record_delta(codec.record_delta(_plain(a), _plain(b))) for a, b in pairs], dtype=object)


def _plain(record: dict) -> dict:
    return {name: record[name] if kind == "s" else float(record[name]) if kind == "f" else int(record[name]) for name, kind in codec.RECORD}


RECORD = _struct(**{name: {"s": STRING, "f": T.FloatType(), "b": INT, "u": U64}[kind] for name, kind in codec.RECORD}, error=STRING)


@F.pandas_udf(RECORD)
def read_record(data: pd.Series) -> pd.DataFrame:
    """A record's fields from its bytes, or the error's kind."""
    from decimal import Decimal

    rows = []
    for d in data:
        try:
            rows.append({k: Decimal(v) if dict(codec.RECORD)[k] == "u" else v for k, v in codec.decode_record(bytes(d or b"")).items()} | {"error": None})
        except codec.CodecError as e:
            rows.append({name: None for name, _ in codec.RECORD} | {"error": e.kind})
    return pd.DataFrame(rows, columns=[*(name for name, _ in codec.RECORD), "error"])


@F.pandas_udf(BINARY)
def applied_record_delta(base: pd.Series, delta: pd.Series) -> pd.Series:
    """Bytes of the record that a delta makes of a base; null without either. A field that leaves its range fails the query."""
    out = []
    for b, d in zip(base, delta, strict=True):
        out.append(None if b is None or d is None else codec.encode_record(codec.apply_record_delta(codec.decode_record(bytes(b)), codec.decode_record_delta(bytes(d)))))
    return pd.Series(out, dtype=object)


@F.pandas_udf(BINARY)
def unzstd_payload(payload: pd.Series) -> pd.Series:
    return payload.map(lambda p: None if p is None else codec.logical_payload(codec.Packet("snapshot", 0, 0, 0, 0, bytes(p), codec.FLAG_ZSTD)))
