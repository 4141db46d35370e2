"""Pieces of DuckDB SQL that several checks use."""

from __future__ import annotations


def nibble_table() -> list[int]:
    """The CRC-32 of each half byte, by the reversed polynomial."""
    table = []
    for value in range(16):
        for _ in range(4):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        table.append(value)
    return table


def crc32(text: str) -> str:
    """The unsigned CRC-32 of the UTF-8 bytes of the SQL expression `text`."""
    table = ", ".join(f"{x}::BIGINT" for x in nibble_table())
    digits = f"list_transform(range(length(hex({text}))), lambda nibble_no: strpos('0123456789ABCDEF', substr(hex({text}), xor(nibble_no, 1) + 1, 1))::BIGINT - 1)"
    step = f"lambda crc_so_far, nibble: xor([{table}][(xor(crc_so_far, nibble) & 15) + 1], crc_so_far >> 4)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {digits}), {step}), 4294967295::BIGINT)"
