"""Pages that are long in one respect take time in proportion."""

import random
import time

import pytest

from tesserae.llm.html import Table, extract

PAGES = {
    "rows that keep columns": lambda n: "<table>" + "<tr><td rowspan=60000 colspan=1000>a<td>b" * (n // 41),
    "one row of many cells": lambda n: "<table><tr>" + "<td>x" * (n // 5),
    "cells of many lines": lambda n: "<table><tr>" + "<td>x<br>y" * (n // 20) + "<td>" + "z<br>" * (n // 10),
    "titles that don't end": lambda n: "<title" * (n // 6),
    "tags before the last bracket": lambda n: "<p>x" + "<b " * (n // 3),
    "textareas": lambda n: "<textarea>q</textarea>" * (n // 22),
    "comments that don't end": lambda n: "<p>x" + "<a" * (n // 4) + "<!--" + "<b" * (n // 4),
}


@pytest.mark.parametrize("name", sorted(PAGES))
def test_a_megabyte_in_seconds(name):
    began = time.perf_counter()
    text = extract(PAGES[name](1_000_000))
    assert time.perf_counter() - began < 12 and (text or "titles" in name)


def test_text_after_the_last_tag_is_kept():
    assert extract("<p>a</p>x <b y &amp; <i z") == "a\n\nx <b y & <i z"
    assert extract("<p>a</p>x <b <!-- c <i") == "a\n\nx <b"


class Cell:
    def __init__(self, wide, high):
        self.attributes = {"colspan": str(wide), "rowspan": str(high)}


def plain_places(rows):
    """First columns of cells, with a set of the columns that are kept in each row."""
    taken, out = {}, []
    for row in rows:
        taken, column, line, fresh = {c: n - 1 for c, n in taken.items() if n > 1}, 0, [], {}
        for wide, high in row:
            while column in taken:
                column += 1
            line.append(column)
            if high > 1:
                fresh |= dict.fromkeys(range(column, column + wide), high)
            column += wide
        taken |= fresh
        out.append(line)
    return out


@pytest.mark.parametrize("seed", range(40))
def test_kept_columns_equal_brute_force(seed):
    rng = random.Random(seed)
    rows = [[(rng.choice([1, 1, 1, 2, 3]), rng.choice([1, 1, 2, 3, 5])) for _ in range(rng.randint(0, 5))] for _ in range(25)]
    table = Table()
    for row in rows:
        table.row()
        for wide, high in row:
            table.cell(Cell(wide, high), ["x"])
    assert [[c for c, _, _ in row] for row in table.rows] == plain_places(rows)
