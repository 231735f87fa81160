"""The byte codec of columns: bit-packed blocks under the cheapest transform, decimals, 5-bit texts."""

from __future__ import annotations

import numpy as np

from .scalar import BLOCK

RAW, FRAME, DELTA, CONSTANT, DECIMAL, ZIGZAG = 0, 1, 2, 3, 8, 16
U64 = np.uint64
#: Largest decimal exponents of doubles and of floats.
EXPONENT, EXPONENT32 = 18, 12
LETTERS = " abcdefghijklmnopqrstuvwxyz.,"
SHIFT, DIGITS, RAW_BYTE = 29, 30, 31


def zigzag(v: np.ndarray) -> np.ndarray:
    return ((v << 1) ^ (v >> 63)).view(U64)


def unzigzag(u: np.ndarray) -> np.ndarray:
    return (u >> U64(1)).view(np.int64) ^ -(u & U64(1)).view(np.int64)


def pack(block: np.ndarray) -> bytes:
    """A width byte and the values' low bits, least first."""
    width = int(np.bitwise_or.reduce(block)).bit_length() if len(block) else 0
    bits = np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, :width]
    return bytes([width]) + np.packbits(bits.ravel(), bitorder="little").tobytes()


def unpack(buffer: bytes, at: int, n: int) -> tuple[np.ndarray, int]:
    width = buffer[at]
    size = (n * width + 7) // 8
    if width > 64 or at + 1 + size > len(buffer):
        raise ValueError(f"block at byte {at}: {n} values of {width} bits don't fit")
    if n <= SMALL:
        bits, mask = int.from_bytes(buffer[at + 1 : at + 1 + size], "little"), (1 << width) - 1
        return np.array([bits >> width * k & mask for k in range(n)], U64), at + 1 + size
    bits = np.unpackbits(np.frombuffer(buffer, np.uint8, size, at + 1), bitorder="little")[: n * width].reshape(n, width)
    wide = np.zeros((n, 64), np.uint8)
    wide[:, :width] = bits
    return np.packbits(wide, axis=1, bitorder="little").view(U64).ravel(), at + 1 + size


def _widths(values: np.ndarray) -> list[int]:
    """Bits of each block's values."""
    return [x.bit_length() for x in np.bitwise_or.reduceat(values, np.arange(0, len(values), BLOCK)).tolist()] if len(values) else []


def _packed_size(n: int, widths: list[int]) -> int:
    last = n - BLOCK * (len(widths) - 1)
    return len(widths) + BLOCK // 8 * sum(widths[:-1]) + (last * widths[-1] + 7) // 8 if widths else 0


def _blocks(values: np.ndarray, widths: list[int]) -> bytes:
    """Blocks as :func:`pack` writes them; whole blocks of one width are packed at once."""
    whole = len(values) // BLOCK
    out: list[bytes] = [b""] * len(widths)
    wide = np.array(widths[:whole], np.int64)
    for width in set(widths[:whole]):
        at = np.flatnonzero(wide == width)
        bits = np.unpackbits(np.ascontiguousarray(values[: whole * BLOCK].reshape(whole, BLOCK)[at]).view(np.uint8).reshape(-1, 8)[:, : (width + 7) // 8], axis=1, bitorder="little")[:, :width]
        rows = np.packbits(bits.reshape(len(at), BLOCK * width), axis=1, bitorder="little")
        head = bytes([width])
        for k, row in zip(at.tolist(), rows, strict=True):
            out[k] = head + row.tobytes()
    if whole < len(widths):
        out[-1] = pack(values[whole * BLOCK :])
    return b"".join(out)


def _planned(values: np.ndarray):
    """The size of the smallest of raw, frame, delta and constant, an earlier one on ties, and what writes it."""
    v = np.ascontiguousarray(values, np.int64)
    if not len(v):
        return 0, lambda: b""
    if len(v) <= SMALL:
        data = _small(v.tolist())
        return len(data), lambda: data
    least, most = int(v.min()), int(v.max())
    base = lambda x: zigzag(np.array([x], np.int64)).tobytes()
    flag = ZIGZAG if least < 0 else 0
    options = [(bytes([RAW | flag]), zigzag(v) if flag else v.view(U64)), (bytes([FRAME]) + base(least), v.view(U64) - U64(least & 0xFFFFFFFFFFFFFFFF))]
    with np.errstate(over="ignore"):
        step = np.diff(v)
    if len(v) > 1 and not (((v[1:] ^ v[:-1]) & (v[1:] ^ step)) < 0).any():
        options.append((bytes([DELTA | ZIGZAG]) + base(int(v[0])), zigzag(step)))
    if least == most:
        options.append((bytes([CONSTANT]) + base(least), np.zeros(0, U64)))
    widths = [_widths(u) for _, u in options]
    sizes = [len(head) + _packed_size(len(u), w) for (head, u), w in zip(options, widths, strict=True)]
    k = sizes.index(min(sizes))
    return sizes[k], lambda: options[k][0] + _blocks(options[k][1], widths[k])


#: Up to so many values, Python's integers are faster than arrays.
SMALL = 32


def _small(v: list[int]) -> bytes:
    """:func:`encode_ints` of at most ``SMALL`` values, at least one."""
    least, most, first = min(v), max(v), v[0]
    zz = lambda x: x << 1 if x >= 0 else (-x << 1) - 1
    flag = ZIGZAG if least < 0 else 0
    options = [(RAW | flag, b"", [zz(x) for x in v] if flag else v), (FRAME, zz(least).to_bytes(8, "little"), [x - least for x in v])]
    step = [b - a for a, b in zip(v, v[1:])]  # noqa: RUF007
    if step and max(step) < 1 << 63 and min(step) >= -(1 << 63):
        options.append((DELTA | ZIGZAG, zz(first).to_bytes(8, "little"), [zz(x) for x in step]))
    best = None
    for kind, base, u in options:
        either = 0
        for x in u:
            either |= x
        width = either.bit_length()
        size = len(base) + 1 + (len(u) * width + 7) // 8
        if best is None or size < best[0]:
            best = size, kind, base, u, width
    if least == most and best[0] > 8:
        return bytes([CONSTANT]) + zz(least).to_bytes(8, "little")
    size, kind, base, u, width = best
    bits = 0
    for x in reversed(u):
        bits = bits << width | x
    return bytes([kind]) + base + bytes([width]) + bits.to_bytes((len(u) * width + 7) // 8, "little")


def encode_ints(values: np.ndarray) -> bytes:
    """The smallest of raw, frame, delta and constant, an earlier one on ties; empty for no values."""
    return _small(np.asarray(values, np.int64).tolist()) if 0 < len(values) <= SMALL else _planned(values)[1]()


def _unpacked(buffer: bytes, at: int, n: int) -> tuple[np.ndarray, int]:
    """Values of all blocks, whole blocks of one width at once, and the byte after them."""
    whole = n // BLOCK
    if not whole:
        return unpack(buffer, at, n) if n else (np.zeros(0, U64), at)
    out = np.empty(n, U64)
    starts: dict[int, tuple[list[int], list[int]]] = {}
    for k in range(whole):
        width = buffer[at]
        if width > 64 or at + 1 + BLOCK // 8 * width > len(buffer):
            raise ValueError(f"block at byte {at}: {BLOCK} values of {width} bits don't fit")
        blocks, places = starts.setdefault(width, ([], []))
        blocks.append(k)
        places.append(at + 1)
        at += 1 + BLOCK // 8 * width
    data = np.frombuffer(buffer, np.uint8)
    rows = out[: whole * BLOCK].reshape(whole, BLOCK)
    for width, (blocks, places) in starts.items():
        packed = data[np.array(places)[:, None] + np.arange(BLOCK // 8 * width)]
        bits = np.unpackbits(packed, axis=1, bitorder="little").reshape(len(blocks) * BLOCK, width)
        wide = np.zeros((len(bits), 8), np.uint8)
        wide[:, : (width + 7) // 8] = np.packbits(bits, axis=1, bitorder="little")
        rows[blocks] = wide.view(U64).reshape(len(blocks), BLOCK)
    if n % BLOCK:
        out[whole * BLOCK :], at = unpack(buffer, at, n % BLOCK)
    return out, at


def decode_ints(buffer: bytes, n: int, at: int = 0) -> tuple[np.ndarray, int]:
    """``n`` values and the byte after them."""
    if not n:
        return np.zeros(0, np.int64), at
    head = buffer[at]
    kind, at = head & 7, at + 1
    if head & ~(7 | ZIGZAG) or kind > CONSTANT:
        raise ValueError(f"unknown column header {head:#x}")
    base = np.zeros(1, np.int64)
    if kind != RAW:
        base, at = unzigzag(np.frombuffer(buffer, U64, 1, at)), at + 8
    if kind == CONSTANT:
        return np.full(n, base[0]), at
    u, at = _unpacked(buffer, at, n - (kind == DELTA))
    if kind == DELTA:
        return np.cumsum(np.r_[base, unzigzag(u)]), at
    if kind == FRAME:
        return (u + base.view(U64)[0]).view(np.int64), at
    return (unzigzag(u) if head & ZIGZAG else u.view(np.int64)), at


#: The powers of ten one under the other.
POWERS = np.array([10.0**e for e in range(EXPONENT + 1)])[:, None]


def decimal_of(v: np.ndarray, power: float | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Integers at a power of ten, and which give their value back bit for bit."""
    with np.errstate(all="ignore"):
        i = np.rint(v * power) + 0.0  # an integer has no minus zero
        ok = (i >= -(2.0**51)) & (i < 2.0**51) & ((i / power).view(np.int64) == v.view(np.int64))
    return np.where(ok, i, 0).astype(np.int64), ok


def encode_floats(values: np.ndarray) -> bytes:
    """Decimal integers and exceptions if that is smaller than the bit patterns as integers."""
    v = np.ascontiguousarray(values, np.float64)
    size, plain = _planned(v.view(np.int64))
    decimal = _as_decimal(v, v.view(np.int64), decimal_of, EXPONENT) if len(v) else None
    return decimal if decimal is not None and len(decimal) < size else plain()


def worth_converting(bits: np.ndarray, exact: np.ndarray, i: np.ndarray) -> bool:
    """Whether a sample lets decimals be smaller than bit patterns: half of it is exact, and the integers' spread with
    76 bits for each exception is no more than the patterns' spread."""
    reached = int(exact.sum())
    if reached * 2 < len(exact):
        return False
    spread = lambda x: (int(x.max()) - int(x.min())).bit_length() if len(x) else 0
    return spread(i[exact]) * len(exact) + 76 * (len(exact) - reached) <= spread(bits) * len(exact)


def _as_decimal(v: np.ndarray, bits: np.ndarray, scaled, most: int) -> bytes | None:
    """The decimal form under the exponent that reaches most of a sample of 32, or None where the sample says it can't pay."""
    step = max(1, len(v) // 32)
    sample = v[::step][:32]
    tried, exact = scaled(np.ascontiguousarray(np.broadcast_to(sample, (most + 1, len(sample)))), POWERS[: most + 1])
    exponent = int(exact.sum(axis=1).argmax())
    if not worth_converting(bits[::step][:32], exact[exponent], tried[exponent]):
        return None
    # a sample that is the whole column has been converted
    i, ok = (tried[exponent], exact[exponent]) if len(sample) == len(v) else scaled(v, 10.0**exponent)
    last = np.maximum.accumulate(np.where(ok, np.arange(len(v)), -1))
    i = np.where(last >= 0, i[np.maximum(last, 0)], 0)
    miss = np.flatnonzero(~ok)
    return bytes([DECIMAL, exponent]) + len(miss).to_bytes(4, "little") + encode_ints(i) + encode_ints(miss) + encode_ints(bits[miss])


def decode_floats(buffer: bytes, n: int, at: int = 0) -> tuple[np.ndarray, int]:
    """``n`` doubles and the byte after them."""
    if not n or buffer[at] != DECIMAL:
        bits, at = decode_ints(buffer, n, at)
        return bits.view(np.float64), at
    i, miss, bits, exponent, at = _decimal_parts(buffer, n, at)
    out = i / 10.0**exponent
    out[miss] = bits.view(np.float64)
    return out, at


def _decimal_parts(buffer: bytes, n: int, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, int]:
    exponent, misses = buffer[at + 1], int.from_bytes(buffer[at + 2 : at + 6], "little")
    i, at = decode_ints(buffer, n, at + 6)
    miss, at = decode_ints(buffer, misses, at)
    bits, at = decode_ints(buffer, misses, at)
    if misses and ((np.diff(miss) <= 0).any() or miss[-1] >= n or miss[0] < 0):
        raise ValueError("positions of exceptions must ascend within the column")
    return i, miss, bits, exponent, at


def decimal_of32(v: np.ndarray, power: float | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """:func:`decimal_of` for single precision: the division is rounded to a float before it is compared."""
    with np.errstate(all="ignore"):
        i = np.rint(v.astype(np.float64) * power) + 0.0
        ok = (i >= -(2.0**51)) & (i < 2.0**51) & ((i / power).astype(np.float32).view(np.int32) == v.view(np.int32))
    return np.where(ok, i, 0).astype(np.int64), ok


def encode_floats32(values: np.ndarray) -> bytes:
    """As :func:`encode_floats`, for floats: exponents up to 12, exceptions and plain columns as 32-bit patterns."""
    v = np.ascontiguousarray(values, np.float32)
    size, plain = _planned(v.view(np.int32).astype(np.int64))
    decimal = _as_decimal(v, v.view(np.int32).astype(np.int64), decimal_of32, EXPONENT32) if len(v) else None
    return decimal if decimal is not None and len(decimal) < size else plain()


def decode_floats32(buffer: bytes, n: int, at: int = 0) -> tuple[np.ndarray, int]:
    if not n or buffer[at] != DECIMAL:
        bits, at = decode_ints(buffer, n, at)
        return bits.astype(np.int32).view(np.float32), at
    i, miss, bits, exponent, at = _decimal_parts(buffer, n, at)
    out = (i / 10.0**exponent).astype(np.float32)
    out[miss] = bits.astype(np.int32).view(np.float32)
    return out, at


def pack5(text: str) -> bytes | None:
    """A text in units of five bits, or None if that isn't smaller than its UTF-8 bytes.

    Units 0 to 28 are space, a to z, full stop and comma; 29 toggles capitals, 30 takes two units with a number of up to
    three digits that doesn't start with zero, 31 two units with a byte.
    """
    units: list[int] = []
    upper, k = False, 0
    while k < len(text):
        c = text[k]
        if c.isascii() and c.isalpha() and c.isupper() != upper:
            units.append(SHIFT)
            upper = not upper
        if c.lower() in LETTERS and c.isascii():
            units.append(LETTERS.index(c.lower()))
        elif c in "0123456789":
            size = 1
            while c != "0" and size < 3 and text[k + size : k + size + 1] in tuple("0123456789"):
                size += 1
            number = int(text[k : k + size])
            units += [DIGITS, number >> 5, number & 31]
            k += size - 1
        else:
            for b in c.encode():
                units += [RAW_BYTE, b >> 5, b & 31]
        k += 1
    bits = np.unpackbits(np.array(units, np.uint8)[:, None], axis=1)[:, 3:] if units else np.zeros(0, np.uint8)
    out = len(units).to_bytes(2, "little") + np.packbits(bits.ravel()).tobytes()
    return out if len(out) < len(text.encode()) and len(units) < 1 << 16 else None


def unpack5(data: bytes) -> str:
    n = int.from_bytes(data[:2], "little")
    bits = np.unpackbits(np.frombuffer(data, np.uint8, offset=2))[: 5 * n].reshape(n, 5)
    units = (bits @ np.array([16, 8, 4, 2, 1], np.int64)).tolist()
    out, upper, k = bytearray(), False, 0
    while k < n:
        u = units[k]
        if u == SHIFT:
            upper = not upper
        elif u in (DIGITS, RAW_BYTE):
            value = units[k + 1] << 5 | units[k + 2]
            out += str(value).encode() if u == DIGITS else bytes([value])
            k += 2
        else:
            c = LETTERS[u]
            out += (c.upper() if upper else c).encode()
        k += 1
    return out.decode()
