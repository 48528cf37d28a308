"""Dotted paths: globs, path parts as labels, interval and time references."""

from __future__ import annotations

import re
import time as clock
from datetime import UTC, datetime, timedelta

from tidewheel.operators.frames import SECOND, Matcher

# Microseconds per unit of an interval.
INTERVALS = {"s": SECOND, "min": 60 * SECOND, "h": 3600 * SECOND, "d": 86400 * SECOND, "w": 7 * 86400 * SECOND, "mon": 30 * 86400 * SECOND, "y": 365 * 86400 * SECOND}


def part_label(i: int) -> str:
    """Label of the i-th part of a path."""
    return f"__g{i}__"


def path_labels(path: str) -> dict[str, str]:
    return {part_label(i): p for i, p in enumerate(path.split("."))}


def glob_to_regex(glob: str, separator: str = r"\.") -> str:
    """``*`` and ``?`` within a part, ``[ab]``, ``{x,y*}`` (nested), ``**`` over any number of parts, ``\\`` to take the next character as it is."""
    out, i, depth = [], 0, 0
    while i < len(glob):
        c = glob[i]
        if c == "\\" and i + 1 < len(glob):
            out.append(re.escape(glob[i + 1]))
            i += 2
            continue
        if glob.startswith("**", i):
            out.append(".*")
            i += 2
            if glob.startswith(".", i):  # none or several parts
                i += 1
            continue
        if c == "*":
            out.append(f"[^{separator}]*")
        elif c == "?":
            out.append(f"[^{separator}]")
        elif c == ".":
            out.append(r"\.+")
        elif c == "{":
            depth += 1
            out.append("(?:")
        elif c == "}" and depth:
            depth -= 1
            out.append(")")
        elif c == "," and depth:
            out.append("|")
        elif c == "[":
            end = glob.find("]", i + 1)
            if end < 0:
                raise ValueError(f"unclosed [ in {glob!r}")
            out.append("[" + glob[i + 1 : end].replace("\\", "\\\\").replace("!", "^", 1 if glob[i + 1] == "!" else 0) + "]")
            i = end
        else:
            out.append(re.escape(c))
        i += 1
    if depth:
        raise ValueError(f"unclosed {{ in {glob!r}")
    return "".join(out)


def split_path(path: str) -> list[str]:
    """Parts of a glob; dots within braces don't separate."""
    parts, depth, current = [], 0, ""
    for c in path:
        depth += (c == "{") - (c == "}")
        if c == "." and not depth:
            parts.append(current)
            current = ""
        else:
            current += c
    return [*parts, current]


def path_matchers(path: str) -> list[Matcher]:
    """One matcher per part, and none beyond the last part. A plain part is an equality, which reaches the scan."""
    parts = split_path(path)
    out = []
    for i, part in enumerate(parts):
        if part == "*":
            out.append(Matcher(part_label(i), "=~", ".+"))
        elif re.search(r"[*?\[\]{}\\]", part):
            out.append(Matcher(part_label(i), "=~", glob_to_regex(part)))
        else:
            out.append(Matcher(part_label(i), "=", part))
    return [*out, Matcher(part_label(len(parts)), "=", "")]


def parse_interval(text: str) -> int:
    """``1min``, ``2hours``, ``1h30min``, with sign, in microseconds."""
    found = re.findall(r"([+-]?\d+)\s*(s|min|h|d|w|mon|y)[a-z]*", text.strip(), re.I)
    if not found:
        raise ValueError(f"not an interval: {text!r}")
    return sum(int(n) * INTERVALS[u.lower()] for n, u in found)


def parse_time(text: str, now: float | None = None) -> int:
    """A time reference in microseconds UTC: ``now``, ``-1h``, ``today``, ``midnight-1d``, ``noon``, ``yesterday``, seconds, ``HH:MM_YYYYMMDD``, ``YYYYMMDD``, ``MM/DD/YY``."""
    now = clock.time() if now is None else now
    text = text.strip().lower()
    if re.fullmatch(r"\d{9,}(\.\d+)?", text) and len(text) != 8:
        return round(float(text) * SECOND)
    base, offset = re.fullmatch(r"(.*?)([+-]\d+[a-z]+)?", text).groups()
    at = datetime.fromtimestamp(now, UTC)
    day = at.replace(hour=0, minute=0, second=0, microsecond=0)
    if base in ("", "now"):
        when = at
    elif base in ("today", "midnight", "midnight_today"):
        when = day
    elif base == "yesterday":
        when = day - timedelta(days=1)
    elif base == "tomorrow":
        when = day + timedelta(days=1)
    elif base == "noon":
        when = day + timedelta(hours=12)
    elif base == "teatime":
        when = day + timedelta(hours=16)
    else:
        hour, _, date = base.rpartition("_") if "_" in base else ("", "", base) if ":" not in base else (base, "", "")
        when = day
        if date and date not in ("today",):
            for form in ("%Y%m%d", "%m/%d/%y", "%m/%d/%Y"):
                try:
                    when = datetime.strptime(date, form).replace(tzinfo=UTC)
                    break
                except ValueError:
                    continue
            else:
                raise ValueError(f"not a time: {text!r}")
        if hour:
            h, m = hour.split(":")
            when = when.replace(hour=int(h), minute=int(m))
    return round(when.timestamp() * SECOND) + (parse_interval(offset) if offset else 0)
