"""Text forms of plans: CBOR (RFC 8949) deflated and in base 64, as one string."""

from __future__ import annotations

import base64
import hashlib
import struct
import zlib


def _head(major: int, n: int) -> bytes:
    if n < 24:
        return bytes([major << 5 | n])
    for extra, size in ((24, "B"), (25, "H"), (26, "I"), (27, "Q")):
        if n < 1 << 8 * struct.calcsize(size):
            return bytes([major << 5 | extra]) + struct.pack(f">{size}", n)
    raise ValueError("integer too large")


def cbor(x) -> bytes:
    """Definite-length CBOR of None, booleans, integers, floats, text, bytes, lists and dictionaries."""
    if x is None or isinstance(x, bool):
        return {None: b"\xf6", True: b"\xf5", False: b"\xf4"}[x]
    if isinstance(x, int):
        return _head(0, x) if x >= 0 else _head(1, -1 - x)
    if isinstance(x, float):
        return b"\xfb" + struct.pack(">d", x)
    if isinstance(x, bytes):
        return _head(2, len(x)) + x
    if isinstance(x, str):
        raw = x.encode()
        return _head(3, len(raw)) + raw
    if isinstance(x, (list, tuple)):
        return _head(4, len(x)) + b"".join(map(cbor, x))
    return _head(5, len(x)) + b"".join(cbor(k) + cbor(v) for k, v in x.items())


def export(x) -> str:
    """CBOR, raw deflate, base 64."""
    squeeze = zlib.compressobj(9, zlib.DEFLATED, -15)
    return base64.b64encode(squeeze.compress(cbor(x)) + squeeze.flush()).decode()


ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789()"  # fixed value: the format's 64 characters


PREFIX = "!~MDT2~"  # fixed value: the import text's mark


def uid(seed: str, size: int = 11) -> str:
    """A route's id: ``size`` characters of six bits of the seed's digest, so a run's second export takes the place of its first."""
    bits = int.from_bytes(hashlib.sha256(seed.encode()).digest(), "big")
    return "".join(ALPHABET[bits >> 6 * i & 63] for i in range(size))


def route_text(run_id: str, title: str, level: int, dungeon: int, sublevel: int, pulls: list) -> str:
    """The planner's import text of a route: ``pulls`` are (enemies with their clones, colour) in order. Tables that are keyed by numbers stay so."""
    each = [{e["enemy"]: list(e["clones"]) for e in p["enemies"]} | {"color": p["color"]} for p in pulls]
    value = {"currentDungeonIdx": dungeon, "currentSublevel": sublevel, "currentPull": 1, "selection": [1], "pulls": each}
    return PREFIX + export({"text": title, "uid": uid(run_id), "difficulty": level, "value": value, "objects": [], "colorPaletteInfo": {"autoColoring": True, "colorPaletteIdx": 1}})
