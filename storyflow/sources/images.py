"""Dimensions of images from their first bytes, and image addresses from markup."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def image_size(b: bytes | None) -> tuple[str, int, int] | None:
    """(format, width, height) of PNG, GIF, JPEG and WebP data, else None."""
    if not b:
        return None
    try:
        if b[:8] == b"\x89PNG\r\n\x1a\n":
            return ("png", *struct.unpack(">II", b[16:24]))
        if b[:6] in (b"GIF87a", b"GIF89a"):
            return ("gif", *struct.unpack("<HH", b[6:10]))
        if b[:4] == b"RIFF" and b[8:12] == b"WEBP":
            kind = b[12:16]
            if kind == b"VP8X":
                return "webp", 1 + int.from_bytes(b[24:27], "little"), 1 + int.from_bytes(b[27:30], "little")
            if kind == b"VP8L":
                n = int.from_bytes(b[21:25], "little")
                return "webp", 1 + (n & 0x3FFF), 1 + (n >> 14 & 0x3FFF)
            if kind == b"VP8 ":
                w, h = struct.unpack("<HH", b[26:30])
                return "webp", w & 0x3FFF, h & 0x3FFF
            return None
        if b[:2] == b"\xff\xd8":
            at = 2
            while at + 9 <= len(b):
                if b[at] != 0xFF:
                    at += 1
                    continue
                marker = b[at + 1]
                if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):  # frame headers
                    h, w = struct.unpack(">HH", b[at + 5 : at + 9])
                    return "jpeg", w, h
                at += 2 if marker in (0xFF, 0x01) or 0xD0 <= marker <= 0xD9 else 2 + struct.unpack(">H", b[at + 2 : at + 4])[0]
    except struct.error:
        pass
    return None


def image_sizes(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """(key, format, width, height) of binary files; rows that are no image of a known format are left out."""

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, *s) for k, b in zip(pdf[key], pdf[content]) if (s := image_size(b))]
            yield pd.DataFrame(rows, columns=[key, "format", "width", "height"])

    return files.select(key, content).mapInPandas(measure, f"{key} string, format string, width long, height long")


def image_tags(markup: Column) -> Column:
    """``<img>`` elements of markup as array of (url, width, height); missing numbers are null."""
    tags = F.regexp_extract_all(F.coalesce(markup, F.lit("")), F.lit(r"(?i)(<img\b[^>]*>)"), F.lit(1))
    attr = lambda t, name: F.regexp_extract(t, rf"(?i)\b{name}\s*=\s*[\"']?([^\"'\s>]+)", 1)
    return F.transform(tags, lambda t: F.struct(attr(t, "src").alias("url"), attr(t, "width").try_cast("int").alias("width"), attr(t, "height").try_cast("int").alias("height")))


def best_image(markup: Column) -> Column:
    """Address of the largest image; of equal areas the first, unknown areas last."""
    tags = F.filter(image_tags(markup), lambda t: t["url"].rlike("(?i)^https?://"))
    ranked = F.array_sort(F.transform(tags, lambda t, i: F.struct((-F.coalesce(t["width"] * t["height"], F.lit(0))).alias("a"), i.alias("i"), t["url"].alias("url"))))
    return F.try_element_at(ranked, F.lit(1))["url"]
