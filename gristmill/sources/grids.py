"""From a grid of cells to a table: where the header is, what it says, where tables end.

A grid is a list of rows of cells (text or None). Only its first rows are looked at, on
the driver; bodies stay in Spark.
"""

from __future__ import annotations

import re
from itertools import groupby

SCAN_ROWS, FULL = 15, 0.6
PARENT_REACH = 3
DEGENERATE_WIDTH, DEGENERATE_NAMES, PLACEHOLDERS = 8, 3, 0.6
# Sheets that hold no data of their own, by name, beginning or part.
SKIP_NAMES = ("password", "index", "query new", "3mth exp", "group-ceo", "pivot input .v2")
SKIP_PREFIXES, SKIP_PARTS = ("p-",), ("ceo", "pivot")

Row = list[str | None]


def filled(cell: object) -> bool:
    return cell is not None and str(cell).strip() != "" and cell == cell


def numberish(cell: object) -> bool:
    try:
        float(str(cell).replace(",", "."))
    except ValueError:
        return False
    return True


def _share(row: Row, test) -> tuple[int, float]:
    cells = [c for c in row if filled(c)]
    return len(cells), sum(map(test, cells)) / len(cells) if cells else 0.0


def is_year_row(row: Row) -> bool:
    n, share = _share(row, lambda c: bool(re.fullmatch(r"(19|20)\d{2}(\.0)?", str(c).strip())))
    return n >= 2 and share >= 0.8


def is_number_row(row: Row) -> bool:
    n, share = _share(row, numberish)
    return n > 0 and share >= 0.5


def is_header_like(row: Row) -> bool:
    n, share = _share(row, lambda c: not numberish(c))
    return n >= 2 and share >= 0.6


def _has_gap_before_label(row: Row) -> bool:
    flags = [filled(c) for c in row]
    return any(now and not before for before, now in zip(flags, flags[1:]))


def header_row(grid: list[Row]) -> int:
    """Index of the header: the first row filled to FULL of the grid's width that is no line of
    figures; one row further down if that one is a merged parent of it."""
    rows = grid[:SCAN_ROWS]
    counts = [sum(map(filled, r)) for r in rows]
    width = max(counts, default=0)
    full = [i for i, n in enumerate(counts) if width and n >= FULL * width]
    at = next((i for i in full if not is_number_row(rows[i])), full[0] if full else 0)
    if at + 1 < len(rows) and counts[at + 1] >= counts[at]:
        labels = [str(c).strip() if filled(c) else None for c in rows[at]]
        if any(label is not None and len(list(run)) > 1 for label, run in groupby(labels)):
            return at + 1
    return at


def parent_row(grid: list[Row], header: int) -> int | None:
    """Index of the row of labels over the header's columns, up to PARENT_REACH rows above."""
    width = sum(map(filled, grid[header]))
    for at in range(header - 1, max(-1, header - 1 - PARENT_REACH), -1):
        row = grid[at]
        n = sum(map(filled, row))
        if n == 0:
            continue
        merged = not is_number_row(row) and 2 <= n < width and _has_gap_before_label(row)
        return at if is_year_row(row) or merged else None
    return None


def recover_header(grid: list[Row]) -> tuple[list[str], int]:
    """Column names, and the number of the row where the body begins. No names for an empty grid.

    A parent row's labels go before the header's; years are carried on over the columns to
    their right, other parents stand over what their merged cells cover only.
    """
    if not any(any(map(filled, r)) for r in grid[:SCAN_ROWS]):
        return [], 0
    at = header_row(grid)
    own = [str(c).strip() if filled(c) else "" for c in grid[at]]
    over = parent_row(grid, at)
    above = [""] * len(own)
    if over is not None:
        carry, label = is_year_row(grid[over]), ""
        for i, c in enumerate([*grid[over], *[None] * len(own)][: len(own)]):
            label = str(c).strip() if filled(c) else label if carry else ""
            above[i] = label
    names = [f"{a} {b}" if a and b and a != b else a or b or f"col_{i}" for i, (a, b) in enumerate(zip(above, own))]
    return names, at + 1


def clean_names(names: list[str]) -> list[str]:
    """Without quotes, single spaces, repeats numbered ``.1``, ``.2``, ..."""
    out, seen = [], {}
    for name in names:
        name = " ".join(re.sub(r"['\"`]", "", str(name)).split())
        if name in seen:
            seen[name] += 1
            out.append(f"{name}.{seen[name]}")
        else:
            seen[name] = 0
            out.append(name)
    return out


def is_degenerate(names: list[str]) -> bool:
    """Whether the names are those of a dumped pivot: mostly placeholders, or few over many columns."""
    bases = [re.sub(r"\.\d+$", "", n).strip().lower() for n in names]
    real = [b for b in bases if b and not re.fullmatch(r"col_\d+", b) and not b.startswith("unnamed")]
    few = len(names) >= DEGENERATE_WIDTH and len(set(real)) <= DEGENERATE_NAMES
    return not names or len(names) - len(real) >= PLACEHOLDERS * len(names) or few


def skip_sheet(name: str) -> bool:
    n = name.strip().lower()
    return not n or n in SKIP_NAMES or n.startswith(SKIP_PREFIXES) or any(p in n for p in SKIP_PARTS)


def split_regions(blank: list[bool], opens_like_header) -> list[tuple[int, int]]:
    """Spans of rows between runs of two or more blank rows, if every one after the first
    ``opens_like_header``; else the one span of all rows. Spans of one row do not count."""
    spans, start, gap = [], None, 0
    for i, b in enumerate([*blank, True, True]):
        gap = gap + 1 if b else 0
        if not b and start is None:
            start = i
        if gap == 2 and start is not None:
            spans.append((start, i - 1))
            start = None
    spans = [(a, b) for a, b in spans if b - a >= 2]
    if len(spans) <= 1 or not all(opens_like_header(a) for a, _ in spans[1:]):
        return [(0, len(blank))]
    return spans
