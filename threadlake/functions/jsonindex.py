"""Structural index of many JSON texts at once.

All texts of a batch lie in one byte buffer. Bitmaps for quotes, brackets and delimiters are computed for the
whole buffer, strings are found from the parity of unescaped quotes, and nesting depth is a prefix sum over
brackets. Tokens that share a container are brought together by one sort on (level, position), which gives
their parent links and lets the grammar be checked for all texts without walking any of them.
"""

from __future__ import annotations

import json
import re

import numpy as np

_SCALAR = re.compile(rb"true|false|null|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?")
_QUOTE, _BACK, _COMMA, _COLON = 34, 92, 44, 58
_OPEN, _CLOSE = (123, 91), (125, 93)


def _lookup(values: bytes | list[int]) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(values)] = True
    return table


_WS, _BRACKET, _DELIM = _lookup(b" \t\n\r"), _lookup(b"{}[]"), _lookup(b"{}[],:")
_ESC, _HEX = _lookup(b'"\\/bfnrtu'), _lookup(b"0123456789abcdefABCDEF")
_STEP = np.zeros(256, np.int8)
_STEP[list(_OPEN)], _STEP[list(_CLOSE)] = 1, -1


class StructuralIndex:
    """Tokens, spans and parent links of the JSON texts ``texts``; ``readable[i]`` tells whether text i is one JSON value.

    ``kind[t]`` is the token's first byte (``"`` for a string, 0 for a bare scalar), ``start[t]`` and ``end[t]`` its
    span in the buffer (end exclusive, whole value for a container) and ``first[t] .. last[t]`` the range of its
    members in ``order``, which lists tokens container by container. ``root[i]`` is the top value of text i.
    """

    def __init__(self, texts: list[bytes]):
        self.buf = b"\n".join(texts) + b"\n"
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(size + 1)
        row_start = ends - size - 1
        b = np.frombuffer(self.buf, np.uint8)
        n, rows = len(b), len(texts)
        at = np.arange(n, dtype=np.int32)  # a text is below 2 GB
        row = np.repeat(np.arange(rows, dtype=np.int32), size + 1)

        # Quotes that aren't escaped: a byte is escaped after an odd run of backslashes.
        back = b == _BACK
        run = at - np.maximum.accumulate(np.where(back, np.int32(-1), at))
        escaped = np.zeros(n, bool)
        escaped[1:] = (back & (run % 2 == 1))[:-1]
        quote = (b == _QUOTE) & ~escaped
        seen = np.cumsum(quote, dtype=np.int32)
        parity = (seen - (seen[row_start] - quote[row_start])[row]) & 1
        inside = parity == 1  # from the opening quote to before the closing one
        plain = ~inside & ~quote
        bad = np.zeros(rows, bool)
        bad[row[inside & (b < 32)]] = True  # also the row's own end, if a string is left open
        esc = np.flatnonzero(escaped & inside)
        bad[row[esc[~_ESC[b[esc]]]]] = True
        uni = esc[b[esc] == 117]
        for k in range(1, 5):
            p = np.minimum(uni + k, n - 1)
            bad[row[uni[~_HEX[b[p]]]]] = True

        # Depth by prefix sums over brackets outside strings.
        bracket = plain & _BRACKET[b]
        step = np.where(bracket, _STEP[b], 0)
        total = np.cumsum(step, dtype=np.int32)
        depth = total - (total[row_start] - step[row_start])[row]
        bad[row[depth < 0]] = True
        bad[depth[ends - 1] != 0] = True

        # Tokens: delimiters, opening quotes, first bytes of bare scalars.
        delim = plain & _DELIM[b]
        word = plain & ~_DELIM[b] & ~_WS[b]
        begins = word.copy()
        begins[1:] &= ~word[:-1]
        begins[row_start] = word[row_start]
        opening = quote & inside
        pos = np.flatnonzero(delim | opening | begins)
        kind = np.where(begins[pos], 0, b[pos])
        level = depth[pos] - (step[pos] == 1)
        closer = step[pos] == -1
        trow = row[pos]

        # Closers leave the token list; they only end spans.
        cpos, clevel = pos[closer], level[closer]
        keep = ~closer
        pos, kind, level, trow = pos[keep], kind[keep], level[keep], trow[keep]
        key = np.maximum(level, 0) * np.int64(n + 1) + pos
        order = np.argsort(key, kind="stable")
        opener = step[pos] == 1
        okey_order = order[opener[order]]
        okey = key[okey_order]
        holder = np.full(len(pos), -1, np.int64)
        if len(okey):
            found = np.searchsorted(okey, np.maximum(level - 1, 0) * np.int64(n + 1) + pos) - 1
            deep = (level > 0) & (found >= 0)
            holder[deep] = okey_order[found[deep]]

        end = np.zeros(len(pos), np.int64)
        quote_at = np.flatnonzero(quote)
        strings = np.flatnonzero(kind == _QUOTE)
        if len(strings):
            nxt = np.searchsorted(quote_at, pos[strings]) + 1
            end[strings] = np.where(nxt < len(quote_at), quote_at[np.minimum(nxt, len(quote_at) - 1)], n - 1) + 1
        stop_at = np.flatnonzero(~word)
        scalars = np.flatnonzero(kind == 0)
        end[scalars] = np.minimum(stop_at[np.searchsorted(stop_at, pos[scalars])], ends[trow[scalars]] - 1)
        opens = np.flatnonzero(opener)
        if len(opens):
            ckey = np.maximum(clevel, 0) * np.int64(n + 1) + cpos
            corder = np.argsort(ckey, kind="stable")
            hit = np.searchsorted(ckey[corder], key[opens])
            ok = hit < len(corder)
            close = cpos[corder[np.minimum(hit, max(len(corder) - 1, 0))]] if len(corder) else np.full(len(opens), n - 1)
            ok &= (b[close] == b[pos[opens]] + 2) & (row[close] == trow[opens])
            bad[trow[opens[~ok]]] = True
            end[opens] = close + 1
        for t in scalars:
            if not bad[trow[t]] and not _SCALAR.fullmatch(self.buf, pos[t], end[t]):
                bad[trow[t]] = True

        # Grammar: the place of a token among its container's tokens says what it may be.
        h, r = holder[order], trow[order]
        fresh = np.ones(len(order), bool)
        fresh[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
        seg = np.flatnonzero(fresh)
        length = np.diff(np.append(seg, len(order)))
        place = np.arange(len(order)) - np.repeat(seg, length)
        k = kind[order]
        value = (k != _COMMA) & (k != _COLON)
        top = h < 0
        in_obj = ~top & (kind[np.maximum(h, 0)] == 123)
        in_arr = ~top & ~in_obj
        wrong = top & ((place > 0) | ~value)
        wrong |= in_arr & np.where(place % 2 == 0, ~value, k != _COMMA)
        q = place % 4
        wrong |= in_obj & np.select([q == 0, q == 1, q == 2], [k != _QUOTE, k != _COLON, ~value], k != _COMMA)
        bad[r[wrong]] = True
        if len(seg):
            short = np.where(in_arr[seg], length % 2 == 0, in_obj[seg] & (length % 4 != 3))
            bad[r[seg[short.astype(bool)]]] = True

        self.root = np.full(rows, -1, np.int64)
        tops = order[top & (place == 0)]
        self.root[trow[tops]] = tops
        bad[self.root < 0] = True
        self.first, self.last = np.zeros(len(pos), np.int64), np.zeros(len(pos), np.int64)
        held = seg[~top[seg]] if len(seg) else seg
        self.first[h[held]] = held
        self.last[h[held]] = held + length[~top[seg]] if len(seg) else 0
        self.kind, self.start, self.end, self.order = kind, pos, end, order
        self.readable = ~bad

    def text(self, t: int) -> str:
        """The value of a string token, escapes decoded."""
        part = self.buf[self.start[t] : self.end[t]]
        return json.loads(part) if _BACK in part else part[1:-1].decode()

    def raw(self, t: int) -> str:
        """A value as it stands in the text."""
        return self.buf[self.start[t] : self.end[t]].decode()

    def members(self, t: int) -> dict[str, int]:
        """Name to value token of an object; of names that occur twice the last one holds."""
        span = self.order[self.first[t] : self.last[t]]
        return {self.text(a): int(v) for a, v in zip(span[0::4], span[2::4], strict=True)}

    def elements(self, t: int) -> list[int]:
        """Value tokens of an array."""
        return self.order[self.first[t] : self.last[t] : 2].tolist()
