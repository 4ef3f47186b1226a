"""Statements that use the custom aggregates, rewritten to built-in functions before Catalyst parses them."""

from __future__ import annotations

import re
from datetime import timedelta

from pyspark.sql import SparkSession
from pyspark.sql.types import DayTimeIntervalType

from ..functions.registry import NAMES, expression
from ..operators.window import CURSOR, reach_text

_CALL = re.compile(r"\b(" + "|".join(sorted(NAMES, key=len, reverse=True)) + r")\s*\(", re.IGNORECASE)
_SKIP = re.compile(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|--[^\n]*|/\*.*?\*/", re.DOTALL)
_FRAME = re.compile(
    r"PARTITION\s+BY\s+(?P<keys>[\w`.,\s]+?)\s+ORDER\s+BY\s+(?P<time>[\w`.]+)(?:\s+ASC)?\s+RANGE\s+BETWEEN\s+(?P<interval>INTERVAL\b(?:(?!\bPRECEDING\b)[^()])+?)\s+PRECEDING\s+AND\s+CURRENT\s+ROW",
    re.IGNORECASE | re.DOTALL,
)
_RANGE = re.compile(r"\bRANGE\s+BETWEEN\b", re.IGNORECASE)


def interval_us(text: str) -> int:
    """Microseconds of an interval literal, read by Spark's own parser; months have no fixed length and are refused."""
    found = SparkSession.builder.getOrCreate().sql(f"SELECT {text} AS i")
    if not isinstance(found.schema["i"].dataType, DayTimeIntervalType):
        raise ValueError(f"no fixed length: {text}")
    return found.first()["i"] // timedelta(microseconds=1)


def _quoted(sql: str) -> list[tuple[int, int]]:
    return [m.span() for m in _SKIP.finditer(sql)]


def _close(sql: str, start: int, quoted: list[tuple[int, int]]) -> tuple[int, list[str]]:
    """End of the parenthesis opened at ``start``, and its arguments."""
    depth, at, begin, args = 0, start, start + 1, []
    while at < len(sql):
        inside = next((e for s, e in quoted if s <= at < e), None)
        if inside:
            at = inside
            continue
        c = sql[at]
        if c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
            if not depth:
                args.append(sql[begin:at].strip())
                return at + 1, args if args != [""] else []
        elif c == "," and depth == 1:
            args.append(sql[begin:at].strip())
            begin = at + 1
        at += 1
    raise ValueError("a parenthesis is not closed")


def rewrite(sql: str) -> str:
    """``sql`` with every custom aggregate, plain or OVER a window, in built-in functions."""
    done = 0
    while True:
        quoted = _quoted(sql)
        found = next((m for m in _CALL.finditer(sql, done) if not any(s <= m.start() < e for s, e in quoted)), None)
        if not found:
            return sql
        end, args = _close(sql, found.end() - 1, quoted)
        over = ""
        if m := re.compile(r"\s+OVER\s*", re.IGNORECASE).match(sql, end):
            if sql[m.end()] == "(":
                stop, _ = _close(sql, m.end(), quoted)
            else:
                stop = re.compile(r"\w+|`[^`]*`").match(sql, m.end()).end()
            over, end = sql[m.end() : stop], stop
        text = expression(found[1].lower(), [rewrite(a) for a in args], over)
        sql = f"{sql[: found.start()]}{text}{sql[end:]}"
        done = found.start() + len(text)


def exact_frames(sql: str) -> tuple[str, list[tuple[list[str], str]]]:
    """``sql`` with its interval frames ordered by cursors of ``operators.window``, and the (keys, time) that each cursor is made of.

    Cursor n is the column ``cursor_name(n)``. A RANGE frame of another form is
    refused, for peers would be in it without a word.
    """
    quoted = _quoted(sql)
    outside = lambda at: not any(s <= at < e for s, e in quoted if sql[s] not in "'`\"")  # noqa: E731  (comments)
    found = [m for m in _FRAME.finditer(sql) if outside(m.start())]
    covered = [m.span() for m in found]
    for m in _RANGE.finditer(sql):
        if not any(s <= m.start() < e for s, e in quoted) and not any(s <= m.start() < e for s, e in covered):
            raise ValueError(f"no exact frame can be made of {' '.join(sql[m.start() : m.start() + 80].split())!r}; set exact_ties to false for frames with all peers")
    specs: list[tuple[list[str], str]] = []

    def frame(m: re.Match) -> str:
        spec = ([k.strip().strip("`").split(".")[-1] for k in m["keys"].split(",")], m["time"].strip("`").split(".")[-1])
        if spec not in specs:
            specs.append(spec)
        return f"PARTITION BY {m['keys']} ORDER BY {cursor_name(specs.index(spec))} RANGE BETWEEN {reach_text(interval_us(m['interval']))} PRECEDING AND CURRENT ROW"

    out = _FRAME.sub(lambda m: frame(m) if outside(m.start()) else m[0], sql)
    return out, specs


def cursor_name(n: int) -> str:
    return f"{CURSOR}{n}"
