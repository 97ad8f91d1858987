"""What the first and last bytes of an artifact say. Nothing is ever loaded: pickles are walked, archives listed."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadscope.functions.text import extname
from loadscope.operators.artifacts import classify, compatible
from loadscope.operators.columns import mapped
from loadscope.plans.dims import BY_EXTENSION, NOTABLE_CALLABLES

# Limits of a walk, and the pickle format's opcodes by what follows them.
MOST_OPCODES, MOST_MEMBERS, MOST_GLOBALS = 20_000, 4096, 256
FIXED = dict.fromkeys(b"\x80\x4b\x71\x68\x82", 1) | dict.fromkeys(b"\x4d\x83", 2) | dict.fromkeys(b"\x4a\x72\x6a\x84", 4) | dict.fromkeys(b"\x47\x95", 8)
COUNTED = dict.fromkeys(b"\x8c\x55\x43\x8a", 1) | dict.fromkeys(b"\x58\x54\x42\x8b", 4) | dict.fromkeys(b"\x8d\x8e\x96", 8)
LINES = dict.fromkeys(b"\x49\x4c\x46\x70\x67\x50\x53\x56", 1) | dict.fromkeys(b"\x63\x69", 2)
TEXTS, BLOBS, INVOKING = frozenset(b"\x8c\x58\x8d\x55\x54\x53\x56"), frozenset(b"\x42\x43\x8e\x96"), {0x52: "REDUCE", 0x69: "INST", 0x6F: "OBJ", 0x81: "NEWOBJ", 0x92: "NEWOBJ_EX", 0x62: "BUILD"}
PICKLE = "struct<protocol:int,globals:array<string>,invokes_callable:boolean,invoking_opcodes:array<string>,truncated:boolean>"


def walk_pickle(data: bytes) -> tuple[int | None, list[str], bool, list[str], bool]:
    """(protocol, globals, invokes, invoking opcodes, truncated) of a pickle's opcodes, without running any."""
    protocol, names, invoking, last = None, [], [], [None, None]
    at, n = 0, len(data)
    for _ in range(MOST_OPCODES):
        if at >= n:
            return protocol, names, bool(invoking), invoking, True
        op = data[at]
        at += 1
        arguments: list[bytes] = []
        if op in FIXED or op in COUNTED:
            width = FIXED.get(op) or COUNTED[op]
            raw = data[at : at + width]
            at += width
            if op in COUNTED and len(raw) == width:
                size = int.from_bytes(raw, "little")
                if size > n - at:
                    return protocol, names, bool(invoking), invoking, True
                raw = data[at : at + size]
                at += size
            elif len(raw) < width:
                return protocol, names, bool(invoking), invoking, True
            arguments = [raw]
        for _ in range(LINES.get(op, 0)):
            end = data.find(b"\n", at)
            if end < 0:
                return protocol, names, bool(invoking), invoking, True
            arguments.append(data[at:end])
            at = end + 1
        text = [a.decode("utf-8", "replace")[:200] for a in arguments]
        if op == 0x80:
            protocol = arguments[0][0]
        elif op in TEXTS:
            last = [last[1], text[0].strip("'\"")]
        elif op in BLOBS:
            last = [last[1], None]
        elif op in (0x63, 0x69):
            names.append(".".join(text))
        elif op == 0x93:
            names.append(".".join(last) if all(last) else "<stack-global>")
        elif op in (0x82, 0x83, 0x84):
            names.append("<extension-registry>")
        if op in INVOKING and INVOKING[op] not in invoking:
            invoking.append(INVOKING[op])
        if op == 0x2E:
            return protocol, list(dict.fromkeys(names))[:MOST_GLOBALS], bool(invoking), invoking, False
    return protocol, list(dict.fromkeys(names))[:MOST_GLOBALS], bool(invoking), invoking, True


def list_zip(head: bytes, tail: bytes, tail_offset: int) -> list[str] | None:
    """Names in a zip archive's directory at its end, or else in the local headers at its start; null if it is none."""
    if not head.startswith((b"PK\x03\x04", b"PK\x05\x06")):
        return None
    end = tail.rfind(b"PK\x05\x06", max(0, len(tail) - 65_557))
    names: list[str] = []
    if end >= 0 and len(tail) >= end + 22:
        count, at = struct.unpack_from("<H", tail, end + 10)[0], struct.unpack_from("<I", tail, end + 16)[0] - tail_offset
        while 0 <= at and len(tail) >= at + 46 and tail[at : at + 4] == b"PK\x01\x02" and len(names) < min(count, MOST_MEMBERS):
            name, extra, comment = struct.unpack_from("<HHH", tail, at + 28)
            names.append(tail[at + 46 : at + 46 + name].decode("utf-8", "replace"))
            at += 46 + name + extra + comment
    if names:
        return names
    at = 0
    while len(head) >= at + 30 and head[at : at + 4] == b"PK\x03\x04" and len(names) < MOST_MEMBERS:
        size, (name, extra) = struct.unpack_from("<I", head, at + 18)[0], struct.unpack_from("<HH", head, at + 26)
        names.append(head[at + 30 : at + 30 + name].decode("utf-8", "replace"))
        at += 30 + name + extra + size
        if not size:
            break
    return names


def tensor_header(head: bytes, size: int) -> int | None:
    """How many tensors a safetensors header lists; null if there is no such header within the file."""
    if len(head) < 10 or head[8:9] != b"{":
        return None
    length = int.from_bytes(head[:8], "little")
    if not 2 <= length <= size - 8:
        return None
    if length > len(head) - 8:
        return -1
    try:
        return sum(k != "__metadata__" for k in json.loads(head[8 : 8 + length]))
    except (ValueError, RecursionError):
        return None


def probe(files: DataFrame) -> DataFrame:
    """files (path, size, head, tail) with `members`, `tensors` and `pickle` of their bytes."""

    @F.pandas_udf(f"members array<string>, tensors long, pickle {PICKLE}")
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        keys = ("protocol", "globals", "invokes_callable", "invoking_opcodes", "truncated")
        for heads, tails, sizes in batches:
            rows = []
            for head, tail, size in zip(heads, tails, sizes, strict=True):
                head, tail = head or b"", tail or b""
                seen = walk_pickle(head) if head[:1] == b"\x80" and head[1:2] in (b"\1", b"\2", b"\3", b"\4", b"\5") or head[:1] in (b"c", b"(", b"]", b"}") else None
                if seen and head[:1] != b"\x80" and not (seen[1] or seen[2]):
                    seen = None
                rows.append((list_zip(head, tail, max(0, size - len(tail))), tensor_header(head, size), dict(zip(keys, seen, strict=True)) if seen else None))
            yield pd.DataFrame(rows, columns=["members", "tensors", "pickle"])

    return files.withColumn("_p", run("head", "tail", "size")).select(*files.columns, "_p.*")


def classified(probed: DataFrame) -> DataFrame:
    """probed files with `found`: (format, basis, mismatch)."""
    extension = extname(F.col("path"))
    guess = mapped(extension, BY_EXTENSION, "unknown")
    has = lambda pattern: F.exists("members", lambda m: m.rlike(pattern))
    inside = (
        F.when(has("(^|/)code/") & has(r"(^|/)(data|constants)\.pkl\z"), "torchscript")
        .when(has(r"(^|/)data\.pkl\z"), "pytorch-zip")
        .when(has(r"^(config|metadata)\.json\z"), "keras-v3")
        .when((F.size("members") > 0) & F.forall("members", lambda m: m.rlike(r"\.npy\z")), "numpy-npz")
        .otherwise(guess)
    )
    verdict = lambda fmt, basis: F.struct(fmt.alias("format"), F.lit(basis).alias("basis"), ((guess != "unknown") & (fmt != "unknown") & ~compatible(guess, fmt)).alias("mismatch"))
    legacy = F.when(extension.isin(".pt", ".pth", ".ckpt"), "pytorch-legacy").when(guess == "joblib", "joblib").otherwise("pickle")
    found = F.when(F.col("members").isNotNull(), verdict(inside, "container")).when(F.col("tensors").isNotNull(), verdict(F.lit("safetensors"), "magic")).when(F.col("pickle").isNotNull(), verdict(legacy, "magic"))
    return probed.withColumn("found", found.otherwise(classify(F.col("path"), F.coalesce("head", F.lit(b"")))))


def notable(names: Column) -> Column:
    return F.filter(names, lambda g: g.isin(NOTABLE_CALLABLES))


def notable_first(names: Column) -> Column:
    """The same names, the notable ones first, otherwise in their order."""
    return F.concat(notable(names), F.filter(names, lambda g: ~g.isin(NOTABLE_CALLABLES)))
