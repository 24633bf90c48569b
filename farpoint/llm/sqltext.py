"""Pieces of DuckDB SQL that several of this subpackage's queries share."""

from __future__ import annotations


def crc32(text: str) -> str:
    """The unsigned CRC-32 of the UTF-8 of ``text``, a half byte at a time from the low one on."""
    table = []
    for i in range(16):
        for _ in range(4):
            i = (i >> 1) ^ (0xEDB88320 if i & 1 else 0)
        table.append(i)
    halves = f"list_transform(string_split(hex(encode({text})), ''), lambda h: CAST(instr('123456789ABCDEF', h) AS BIGINT))"
    halves = f"(SELECT list_transform(range(len(crc_halves)), lambda i: crc_halves[xor(i, 1) + 1]) FROM (SELECT {halves} AS crc_halves))"
    return f"xor(4294967295, list_reduce({halves}, lambda c, h: xor(c // 16, {table}[1 + xor(c, h) % 16]), CAST(4294967295 AS BIGINT)))"
