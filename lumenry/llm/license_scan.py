"""Operator 3: licence scan by Dice coefficient over word bigrams.

Texts and templates are normalised to lower-case words without punctuation and become
bigrams. A template of n bigrams can reach the least coefficient only in a document with
enough bigrams, and only where enough of its own occur; both bounds prune most (document,
template) pairs. In the rest, windows that begin at one of its bigrams are compared, over the whole
text, and the best of overlapping ones is kept: windows of the template's size, or, with
``any_length`` as in the query, windows of every length.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash
from .store import short_batches

LEAST = 0.8

#: Public licence notices.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
    "MIT": "Released under the MIT License.",
    "MIT-permission": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "LGPL-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}

SPANS = "array<struct<license:string,dice:double,start:int,words:int>>"


def bigrams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bigram hashes of each row in order, and row offsets."""
    hashed, first = wordhash.words(column, marks=True)
    if len(hashed) < 2:
        return np.zeros(0, np.uint64), np.zeros(len(first), np.int64)
    pairs = wordhash.mix(hashed[:-1] * np.uint64(0x9FB21C651E98DF25) + hashed[1:])
    keep = np.ones(len(pairs), bool)
    inner = first[1:-1]
    keep[inner[(inner > 0) & (inner < len(hashed))] - 1] = False
    return pairs[keep], np.concatenate([[0], np.cumsum(np.maximum(0, np.diff(first) - 1))])


def neighbours(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every place the last and the next place of the same value, -1 and the length where there is none."""
    order = np.argsort(flat, kind="stable")
    same = flat[order[1:]] == flat[order[:-1]]
    before, after = np.full(len(flat), -1), np.full(len(flat), len(flat))
    before[order[1:][same]], after[order[:-1][same]] = order[:-1][same], order[1:][same]
    return before, after


class Templates:
    """Distinct bigrams of all templates, ascending, and for each of them the templates that hold it."""

    def __init__(self, texts: dict[str, str]) -> None:
        self.names = list(texts)
        flat, off = bigrams(pa.array(list(texts.values()), pa.large_string()))
        own = [np.unique(flat[a:b]) for a, b in zip(off, off[1:])]
        self.sizes = np.array([len(x) for x in own])
        self.lengths = np.diff(off)
        self.known = np.unique(np.concatenate(own)) if own else np.zeros(0, np.uint64)
        self.holds = np.stack([np.isin(self.known, x) for x in own], 1) if own else np.zeros((0, 0), bool)
        self.table = np.zeros(1 << 16, bool)
        self.table[(self.known & np.uint64(0xFFFF)).astype(np.int64)] = True

    def hits(self, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of template bigrams and their numbers."""
        at = np.flatnonzero(self.table[(flat & np.uint64(0xFFFF)).astype(np.int64)])
        number = np.minimum(np.searchsorted(self.known, flat[at]), max(0, len(self.known) - 1))
        same = self.known[number] == flat[at] if len(self.known) else np.zeros(0, bool)
        return at[same], number[same]

    def windows(self, size: int, place: np.ndarray, before: np.ndarray, after: np.ndarray, least: float) -> list[tuple[float, int, int]]:
        """For every hit of a template of ``size`` bigrams the best window that begins there, if it reaches ``least``.

        ``before`` and ``after`` hold the places of the last and next equal bigram. A window of more than
        ``most`` distinct bigrams cannot reach the least; one that holds its first bigram again is no
        better than that without the first, and one that ends beside a hit no better than a shorter.
        """
        own, best = np.zeros(len(before), bool), []
        own[place] = True
        most, need = (2 - least) / least * size + 1e-9, math.ceil(least * size / (2 - least) - 1e-9)
        ends = np.searchsorted(place, after[place], "left") - np.arange(len(place))
        for a in place[ends >= need]:
            end, length = int(after[a]), 2 * int(most) + 2
            while True:
                b = min(end, a + length)
                new = before[a:b] < a
                window = np.cumsum(new)
                if b == end or window[-1] > most:
                    break
                length *= 2
            dice = 2 * np.cumsum(new & own[a:b]) / (size + window)
            k = int(dice.argmax())
            if dice[k] >= least:
                best.append((float(dice[k]), int(a), k + 1))
        return best

    def spans(self, flat: np.ndarray, at: np.ndarray, number: np.ndarray, least: float, any_length: bool = False) -> list[tuple[str, float, int, int]]:
        """Matches in one document from its bigrams and the places and numbers of its hits."""
        total = len(flat)
        distinct = self.holds[np.unique(number)].sum(0)
        out, equal = [], None
        for t in np.flatnonzero((self.sizes > 0) & (distinct * 2 >= least * self.sizes) & (total * (2 - least) >= least * self.sizes)):
            own = self.holds[number, t]
            place, kind, size, length = at[own], number[own], int(self.sizes[t]), int(self.lengths[t])
            need = math.ceil(least * size / 2)
            best: list[tuple[float, int, int]] = []
            if any_length:
                if distinct[t] * (2 - least) < least * size - 1e-9:
                    continue
                equal = equal or neighbours(flat)
                best, place = self.windows(size, place, *equal, least), place[:0]
            ends = np.searchsorted(place, place + length, "left")
            for k in np.flatnonzero(ends - np.arange(len(place)) >= need):
                span = min(length, total - int(place[k]))
                both, window = len(np.unique(kind[k : ends[k]])), len(np.unique(flat[place[k] : place[k] + span]))
                dice = 2 * both / (size + window)
                if dice >= least:
                    best.append((dice, int(place[k]), span))
            free = np.ones(total + 1, bool)
            for dice, start, span in sorted(best, key=lambda x: (-x[0], x[1])):
                if free[start : start + span].all():
                    free[start : start + span] = False
                    out.append((self.names[t], dice, start, span + 1))
        return sorted(out, key=lambda x: (-x[1], x[2], x[0]))


def scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST, templates: dict[str, str] = TEMPLATES, any_length: bool = False
) -> DataFrame:
    """``(id_col, licenses)`` for every row; licences with coefficient, first word (from 0) and length in words.

    Best matches come first, then earlier ones. Null, empty and one-word texts have none.
    Repeated rows and null ids are each scanned; an empty table gives no rows; other
    columns are not read.
    """
    known = Templates(templates)
    short_batches(docs.sparkSession)

    def scanned(batches):
        for batch in batches:
            for lo, hi in wordhash.slices(batch.column("text")):
                flat, off = bigrams(batch.column("text").slice(lo, hi - lo))
                at, number = known.hits(flat)
                bound = np.searchsorted(at, off)
                found = []
                for r in range(hi - lo):
                    a, b = bound[r], bound[r + 1]
                    hits = known.spans(flat[off[r] : off[r + 1]], at[a:b] - off[r], number[a:b], least, any_length) if b > a else []
                    found.append([{"license": n, "dice": d, "start": s, "words": w} for n, d, s, w in hits])
                kind = pa.list_(pa.struct([("license", pa.string()), ("dice", pa.float64()), ("start", pa.int32()), ("words", pa.int32())]))
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(lo, hi - lo), pa.array(found, kind)], [id_col, "licenses"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(scanned, f"`{id_col}` long, licenses {SPANS}")


def op3(spark, sf_dir: str) -> DataFrame:
    """Every document: how many licence notices it holds, and the best of them (null if none)."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), any_length=True)
    top = F.get("licenses", F.lit(0))
    return found.select(
        "doc_id",
        F.size("licenses").cast("long").alias("n_licenses"),
        top["license"].alias("license"),
        top["dice"].alias("dice"),
        top["start"].alias("start_word"),
        top["words"].alias("n_words"),
    )
