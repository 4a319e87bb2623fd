"""SQL that several of the subpackage's oracles share."""

#: CTEs after one named m(m varchar), which holds distinct strings: _t(k, b, c) is what a byte b with k bytes after it adds to a CRC-32, _z(k, c) the register after k zero bytes.
CRC_TABLES = """
_b as (select range as b, 0 as r, range::bigint as c from range(256)
       union all select b, r + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from _b where r < 8),
_t0 as (select b, c from _b where r = 8),
_far as (select coalesce(max(octet_length(encode(m))), 0) as n from m),
_t as (select 0 as k, b, c from _t0 union all select k + 1, _t.b, xor(_t.c >> 8, _t0.c) from _t join _t0 on _t0.b = _t.c & 255 where k < (select n from _far)),
_z as (select 0 as k, 4294967295::bigint as c union all select k + 1, xor(_z.c >> 8, _t0.c) from _z join _t0 on _t0.b = _z.c & 255 where k < (select n from _far)),
"""


def crc_of(column: str) -> str:
    """A query (m, crc) of the strings of m: contributions of their bytes, and of as many zero bytes."""
    return f"""select p.m, xor(bit_xor(_t.c), xor(any_value(_z.c), 4294967295)) as crc
      from (select m, octet_length(encode({column})) as n, unnest(range(octet_length(encode({column})))) as i, hex(encode({column})) as x from m) p
      join _t on _t.k = p.n - 1 - p.i and _t.b = ('0x' || substr(p.x, 2 * p.i + 1, 2))::int join _z on _z.k = p.n group by p.m"""
