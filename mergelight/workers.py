"""Small per-row helpers that run in Python workers.

The module is pickled by value, so workers need no copy of the package.
"""

from __future__ import annotations

import ast
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

UNREADABLE = (SyntaxError, ValueError, RecursionError, MemoryError)


def function_nodes(tree: ast.AST) -> list[ast.AST]:
    """Function definitions of a tree, outer before inner, in text order."""
    found, pending = [], [tree]
    while pending:
        node = pending.pop()
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            found.append(node)
        pending.extend(reversed(list(ast.iter_child_nodes(node))))
    return found


def python_functions(content: str) -> list[tuple]:
    """Name, first and last line, body and parameters of every function."""
    lines = content.split("\n")
    return [
        (
            node.name, node.lineno, node.end_lineno,
            "\n".join(lines[node.lineno - 1:node.end_lineno]), f"({ast.unparse(node.args)})",
        )
        for node in function_nodes(ast.parse(content))
    ]


def python_import_targets(content: str) -> list[str]:
    """Modules named by import statements; a text that does not parse names none."""
    try:
        tree = ast.parse(content)
    except UNREADABLE:
        return []
    targets = []
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            targets.extend(alias.name for alias in node.names)
        elif isinstance(node, ast.ImportFrom) and node.module:
            targets.append(node.module)
    return targets


def import_targets(content: pd.Series) -> pd.Series:
    """Import targets of a batch of Python texts; nulls stay null."""
    return content.map(python_import_targets, na_action="ignore")


def sample_functions(sample: str) -> list[tuple]:
    """Name, async flag, return hint, docstring and length of each function of a sample."""
    try:
        tree = ast.parse(sample)
    except UNREADABLE:
        return []
    return [
        (
            node.name, isinstance(node, ast.AsyncFunctionDef), node.returns is not None,
            ast.get_docstring(node, clean=False), node.end_lineno - node.lineno + 1,
        )
        for node in function_nodes(tree)
    ]


FINAL, DEAD, OPEN = 0, 1, 2


class Seen:
    """Findings by line, listed by category and by single title words.

    Two findings are similar when they have the same category or share two words.
    """

    def __init__(self, reach: int) -> None:
        self.reach = reach
        self.categories: dict[int, dict[str, object]] = {}
        self.words: dict[int, dict[str, list]] = {}

    def of_category(self, line: int, category: str) -> object | None:
        """The earliest finding of a category near a line."""
        found = None
        for near in range(line - self.reach, line + self.reach + 1):
            seq = self.categories.get(near, {}).get(category)
            if seq is not None and (found is None or seq < found):
                found = seq
        return found

    def earliest(self, line: int, category: str, words: list[str]) -> object | None:
        """The earliest similar finding near a line."""
        if not self.categories:
            return None
        found = self.of_category(line, category)
        for near in range(line - self.reach, line + self.reach + 1):
            listed = self.words.get(near)
            if not listed:
                continue
            once = set()
            for word in words:
                for seq in listed.get(word, ()):
                    if found is not None and seq >= found:
                        break  # lists are in order
                    if seq in once:
                        found = seq
                    else:
                        once.add(seq)
        return found

    def add(self, line: int, category: str, words: list[str], seq) -> None:
        """Findings come in rising order, so the first one of a category and line stays."""
        self.categories.setdefault(line, {}).setdefault(category, seq)
        listed = self.words.setdefault(line, {})
        for word in words:
            listed.setdefault(word, []).append(seq)


class BlockFold:
    """One block: findings in order; seeds, and what later findings may hang on."""

    def __init__(self, reach: int) -> None:
        self.reach = reach
        self.seeds, self.waiting = Seen(reach), Seen(reach)
        self.uncertain: set[int] = set()  # lines with a cell that has more than this round sees

    def decide(self, line: int, category: str, words: list[str], seq, foreign: bool, more: bool) -> tuple:
        """(state, seed) of the next finding; foreign ones belong to the next block and only wait."""
        seed = None if foreign else self.seeds.earliest(line, category, words)
        unsettled = foreign or self.waiting.earliest(line, category, words) is not None or (
            bool(self.uncertain) and any(
                near in self.uncertain for near in range(line - self.reach, line + self.reach + 1)
            )
        )
        if seed is not None:
            state = DEAD if unsettled else FINAL
        elif unsettled:
            state = OPEN
            self.waiting.add(line, category, words, seq)
        else:
            state, seed = FINAL, seq
            self.seeds.add(line, category, words, seq)
        if more and (foreign or self.seeds.of_category(line, category) is None):
            self.uncertain.add(line)
        return state, seed if state == FINAL else None


def fold_blocks(batches: Iterator[pa.RecordBatch], reach: int) -> Iterator[pa.RecordBatch]:
    """State and seed of findings that come sorted by block and ``seq``; seeds of one block are held."""
    names = ["job_id", "file_path", "block", "line_number", "category", "title_words", "seq", "foreign", "more"]
    kept = ["job_id", "file_path", "line_number", "category", "title_words", "seq"]
    current, fold = None, BlockFold(reach)
    for batch in batches:
        states, chosen = [], []
        rows = zip(*(batch[c].to_pylist() for c in names))
        for job, path, block, line, category, words, seq, foreign, more in rows:
            if current != (job, path, block):
                current, fold = (job, path, block), BlockFold(reach)
            state, seed = fold.decide(line, category, words.split(" ") if words else [], seq, foreign, more)
            states.append(state)
            chosen.append(seed)
        out = pa.RecordBatch.from_arrays(
            [*[batch[c] for c in kept], pa.array(chosen, batch["seq"].type), pa.array(states, pa.int32()), batch["more"]],
            names=[*kept, "cluster_seq", "state", "more"],
        )
        yield out.filter(pc.invert(batch["foreign"]))


def number_sorted(
    batches: Iterator[pa.RecordBatch], key: str, offsets: dict[int, int]
) -> Iterator[pa.RecordBatch]:
    """Number the rows of each key from 1; rows come sorted, ``offsets`` has what lies before a part."""
    last, count = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        if last is None:
            last, count = (batch[key][0].as_py(),), offsets.get(batch["_part"][0].as_py(), 0)
        codes = batch[key].dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
        starts = np.concatenate(([0], np.flatnonzero(codes[1:] != codes[:-1]) + 1))
        sizes = np.diff(np.append(starts, len(codes)))
        numbers = np.arange(1, len(codes) + 1) - np.repeat(starts, sizes)
        if batch[key][0].as_py() == last[0]:
            numbers[: sizes[0]] += count
        last, count = (batch[key][-1].as_py(),), int(numbers[-1])
        names = [name for name in batch.schema.names if name != "_part"]
        yield pa.RecordBatch.from_arrays(
            [*[batch[name] for name in names], pa.array(numbers, pa.int64())], names=[*names, "number"]
        )


cloudpickle.register_pickle_by_value(sys.modules[__name__])
