"""CRC-32 as DuckDB SQL: a table of the polynomial's 256 remainders, and a fold over the bytes of a text."""

# a CTE with one row; ``t`` is the table
TABLE = """crc_table AS (
  SELECT list(r ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
      lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS r FROM range(256) AS x(i)))"""


def crc32(text: str) -> str:
    """SQL for the checksum of the UTF-8 of ``text``; ``t`` of ``crc_table`` must be in scope."""
    bytes_ = (f"list_transform(range(0, length(hex(encode({text}))), 2), "
              f"lambda p: CAST('0x' || substr(hex(encode({text})), CAST(p + 1 AS BIGINT), 2) AS BIGINT))")
    return (f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bytes_}), "
            f"lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295::BIGINT)")
