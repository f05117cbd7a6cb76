"""Compound files (MS-CFB) and the formats kept in them: old word, slide and workbook files, by the published file formats."""

from __future__ import annotations

import re
import struct

SIGNATURE = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
LAST_REGULAR = 0xFFFFFFFA


class Compound:
    """The streams of a compound file by their paths."""

    def __init__(self, data: bytes):
        if not data.startswith(SIGNATURE) or len(data) < 512:
            raise ValueError("no compound file")
        self.data = data
        (shift, mini_shift) = struct.unpack_from("<HH", data, 30)
        (directory, _, self.cutoff, mini_fat, _, difat, more) = struct.unpack_from("<IIIIIII", data, 48)
        self.size, self.mini = 1 << shift, 1 << mini_shift
        tables = list(struct.unpack_from("<109I", data, 76))
        while difat < LAST_REGULAR and more:
            page = struct.unpack(f"<{self.size // 4}I", self._sector(difat))
            tables, difat, more = tables + list(page[:-1]), page[-1], more - 1
        self.fat = [x for t in tables if t < LAST_REGULAR for x in struct.unpack(f"<{self.size // 4}I", self._sector(t))]
        entries = self._chain(directory)
        self.nodes = [entries[i : i + 128] for i in range(0, len(entries) - 127, 128)]
        small = self._chain(mini_fat) if mini_fat < LAST_REGULAR else b""
        self.small_fat = struct.unpack(f"<{len(small) // 4}I", small)
        self.small = self._chain(struct.unpack_from("<I", self.nodes[0], 116)[0]) if self.nodes else b""

    def _sector(self, n: int) -> bytes:
        part = self.data[(n + 1) * self.size : (n + 2) * self.size]
        return part.ljust(self.size, b"\0")

    def _chain(self, first: int) -> bytes:
        out, seen = [], set()
        while first < LAST_REGULAR and first < len(self.fat) and first not in seen:
            seen.add(first)
            out.append(self._sector(first))
            first = self.fat[first]
        return b"".join(out)

    def streams(self) -> dict[str, bytes]:
        """Streams by name, in the order of the directory; of equal names the first."""
        out: dict[str, bytes] = {}
        for node in self.nodes:
            size, kind = struct.unpack_from("<H", node, 64)[0], node[66]
            if kind == 2:
                out.setdefault(node[: max(0, size - 2)].decode("utf-16-le", "replace"), self._stream(node))
        return out

    def _stream(self, node: bytes) -> bytes:
        first, length = struct.unpack_from("<II", node, 116)
        if length >= self.cutoff:
            return self._chain(first)[:length]
        out, seen = [], set()
        while first < LAST_REGULAR and first < len(self.small_fat) and first not in seen:
            seen.add(first)
            out.append(self.small[first * self.mini : (first + 1) * self.mini])
            first = self.small_fat[first]
        return b"".join(out)[:length]


# The shortest run of readable characters, and what counts as one in two bytes and in one.
SHORTEST = 3
TWO_BYTES = re.compile(rb"(?:[\x20-\x7e\x09\x0a\x0d]\x00|[\x00-\xff][\x4e-\x9f]){%d,}" % SHORTEST)
ONE_BYTE = re.compile(rb"[\x20-\x7e\x09\x0a\x0d]{%d,}" % SHORTEST)
CONTROL = dict.fromkeys([*range(9), 11, 12, *range(14, 32)])


def readable(data: bytes) -> list[str]:
    """Runs of readable text, two-byte ones first, each once."""
    runs = [m[0].decode("utf-16-le", "ignore") for m in TWO_BYTES.finditer(data)] + [m[0].decode("ascii") for m in ONE_BYTE.finditer(data)]
    clean = (r.translate(CONTROL).strip() for r in runs)
    return list(dict.fromkeys(c for c in clean if len(c) >= SHORTEST))


class Encrypted(ValueError):
    pass


class Workbook:
    """Sheets of a BIFF workbook (MS-XLS): name and rows of (column, text)."""

    def __init__(self, stream: bytes):
        self.stream, self.strings, self.sheets = stream, [], []
        self._globals()

    def records(self, at: int):
        """(kind, parts): a record with those that continue it."""
        kind, parts = None, []
        while at + 4 <= len(self.stream):
            k, n = struct.unpack_from("<HH", self.stream, at)
            body = self.stream[at + 4 : at + 4 + n]
            at += 4 + n
            if k == 0x3C and kind is not None:
                parts.append(body)
                continue
            if kind is not None:
                yield kind, parts
            kind, parts = k, [body]
            if k == 0x0A:
                break
        if kind is not None:
            yield kind, parts

    def _globals(self) -> None:
        for kind, parts in self.records(0):
            body = parts[0]
            if kind == 0x2F:
                raise Encrypted("the workbook is protected")
            if kind == 0x85:
                start, size, wide = struct.unpack_from("<I", body)[0], body[6], body[7] & 1
                self.sheets.append((start, body[8 : 8 + size * (1 + wide)].decode("utf-16-le" if wide else "latin-1", "replace")))
            elif kind == 0xFC:
                self.strings = self._shared(parts)

    @staticmethod
    def _shared(parts: list[bytes]) -> list[str]:
        """The shared strings; characters may go on in the next part, which then begins with their width."""
        part, at, out = 0, 8, []

        def take(n: int) -> bytes:
            nonlocal part, at
            got = b""
            while len(got) < n and part < len(parts):
                piece = parts[part][at : at + n - len(got)]
                got += piece
                at += len(piece)
                if at >= len(parts[part]) and len(got) < n:
                    part, at = part + 1, 0
            return got

        for _ in range(struct.unpack_from("<I", parts[0], 4)[0]):
            head = take(3)
            if len(head) < 3:
                break
            left, flags = struct.unpack("<HB", head)
            rich = struct.unpack("<H", take(2))[0] if flags & 8 else 0
            more = struct.unpack("<I", take(4))[0] if flags & 4 else 0
            text, wide = "", flags & 1
            while left and part < len(parts):
                if at >= len(parts[part]):
                    part, at = part + 1, 1
                    if part >= len(parts):
                        break
                    wide = parts[part][0] & 1
                piece = parts[part][at : at + left * (1 + wide)]
                at += len(piece)
                text += piece.decode("utf-16-le" if wide else "latin-1", "replace")
                left -= len(piece) // (1 + wide)
                if not piece:
                    break
            take(4 * rich + more)
            out.append(text)
        return out

    def rows(self, start: int) -> dict[int, dict[int, str]]:
        cells: dict[int, dict[int, str]] = {}
        waiting = None
        for kind, parts in self.records(start):
            b = parts[0]
            put = lambda c, text, r=None: cells.setdefault(struct.unpack_from("<H", b)[0] if r is None else r, {}).__setitem__(c, text)  # noqa: E731, B023
            column = struct.unpack_from("<H", b, 2)[0] if len(b) >= 4 else 0
            if kind == 0xFD:
                n = struct.unpack_from("<I", b, 6)[0]
                put(column, self.strings[n] if n < len(self.strings) else "")
            elif kind == 0x203:
                put(column, number(struct.unpack_from("<d", b, 6)[0]))
            elif kind == 0x27E:
                put(column, number(short_number(struct.unpack_from("<I", b, 6)[0])))
            elif kind == 0xBD:
                for i in range((len(b) - 6) // 6):
                    put(column + i, number(short_number(struct.unpack_from("<I", b, 6 + 6 * i)[0])))
            elif kind == 0x204:
                put(column, string_at(b, 6))
            elif kind == 0x205 and not b[7]:
                put(column, str(b[6]))
            elif kind == 0x06:
                result = b[6:14]
                if result[6:] != b"\xff\xff":
                    put(column, number(struct.unpack("<d", result)[0]))
                elif result[0] == 0:
                    waiting = (struct.unpack_from("<H", b)[0], column)
                elif result[0] == 1:
                    put(column, str(result[2]))
            elif kind == 0x207 and waiting:
                put(waiting[1], string_at(b, 0), waiting[0])
                waiting = None
        return cells


def string_at(body: bytes, at: int) -> str:
    size, flags = struct.unpack_from("<HB", body, at)
    return body[at + 3 : at + 3 + size * (1 + (flags & 1))].decode("utf-16-le" if flags & 1 else "latin-1", "replace")


def short_number(raw: int) -> float:
    """A packed number: an integer or the upper half of a double, perhaps in hundredths."""
    value = float(raw >> 2 if not raw & 0x80000000 else (raw >> 2) - (1 << 30)) if raw & 2 else struct.unpack("<d", struct.pack("<Q", (raw & 0xFFFFFFFC) << 32))[0]
    return value / 100 if raw & 1 else value


def number(value: float) -> str:
    return str(value)
