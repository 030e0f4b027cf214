"""Reproducible splits and folds, decided by a hash of the row key."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulift.functions.columns import HASH_SPACE, hash_number
from tabulift.functions.schema import col, free_name, require_columns
from tabulift.operators.target import is_classification
from tabulift.plans.ranks import HashCounts, hash_counts, passed_cutoffs

SEED = 42
TEST_SIZE = 0.2
FOLDS = 5
TRAIN, TEST = "train", "test"


@dataclass(frozen=True)
class Split:
    """The table with a column ``part`` ("train" or "test") and a note on how it was made. ``column`` tells its name, see ``plain_split``."""

    table: DataFrame
    message: str
    column: str = "part"

    @property
    def train(self) -> DataFrame:
        return self.table.filter(F.col(self.column) == TRAIN).drop(self.column)

    @property
    def test(self) -> DataFrame:
        return self.table.filter(F.col(self.column) == TEST).drop(self.column)


def _check_size(test_size: float) -> None:
    if not 0.0 < test_size < 1.0:
        raise ValueError("test_size must lie between 0 and 1")


def plain_split(df: DataFrame, key, test_size: float = TEST_SIZE, seed: int = SEED) -> DataFrame:
    """Add ``part`` by a hash threshold: no shuffle, and a row keeps its part when the table grows. A table that has a column ``part`` gets ``part_``."""
    _check_size(test_size)
    limit = int(test_size * HASH_SPACE)
    return df.withColumn(free_name(df.columns, "part"), F.when(hash_number(key, seed) < F.lit(limit), TEST).otherwise(TRAIN))


def stratified_split(
    df: DataFrame, target: str, key, test_size: float = TEST_SIZE, seed: int = SEED, counts: HashCounts | None = None
) -> DataFrame:
    """Add ``part`` (named as in ``plain_split``) so that round(test_size * rows) of every class are test rows: those with the smallest hashes."""
    _check_size(test_size)
    quota = F.array(F.floor(F.col("n") * F.lit(test_size) + F.lit(0.5)))
    name = free_name(df.columns, "part")
    placed = passed_cutoffs(df, key, seed, target, F.filter(quota, lambda q: q > 0), name, counts)
    return placed.withColumn(name, F.when(F.col(name) == 0, TEST).otherwise(TRAIN))


def train_test_split(
    df: DataFrame,
    target: str,
    key,
    test_size: float = TEST_SIZE,
    stratify: bool = False,
    seed: int = SEED,
    problem_type: str | None = None,
) -> Split:
    """Split into train and test rows; stratified on request if the problem and the class sizes allow it."""
    require_columns(df, [target])
    name = free_name(df.columns, "part")
    if stratify and is_classification(problem_type):
        counts = hash_counts(df, key, seed, col(target))
        fewest = counts.smallest()
        if fewest >= 2:
            return Split(stratified_split(df, target, key, test_size, seed, counts), "stratified split", name)
        note = f"plain split: the smallest class has {fewest} row(s)"
    elif stratify:
        note = "plain split: not a classification problem"
    else:
        note = "plain split"
    return Split(plain_split(df, key, test_size, seed), note, name)


def kfold(df: DataFrame, key, folds: int = FOLDS, seed: int = SEED) -> DataFrame:
    """Add ``fold`` in 0..folds-1 from the key hash, without a shuffle. A table that has a column ``fold`` gets ``fold_``."""
    return df.withColumn(free_name(df.columns, "fold"), (hash_number(key, seed) % F.lit(folds)).cast("int"))


def stratified_kfold(df: DataFrame, target: str, key, folds: int = FOLDS, seed: int = SEED) -> DataFrame:
    """Add ``fold`` (named as in ``kfold``) so that the folds of a class differ by at most one row; plain folds if a class is too small."""
    counts = hash_counts(df, key, seed, col(target))
    if counts.smallest() < folds:
        return kfold(df, key, folds, seed)
    last_of_fold = F.transform(F.sequence(F.lit(1), F.lit(folds - 1)), lambda j: F.ceil(j * F.col("n") / F.lit(folds)))
    return passed_cutoffs(df, key, seed, target, last_of_fold, free_name(df.columns, "fold"), counts)
