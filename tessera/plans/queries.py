"""All queries of the core, by name, with their SQL."""

from __future__ import annotations

from tessera.plans import checks, datasets, evidence, extraction, lookups, outcomes, ranking, references, reports, selection, texts
from tessera.plans.registry import Book

BOOKS: tuple[Book, ...] = (outcomes.BOOK, references.BOOK, texts.BOOK, datasets.BOOK, checks.BOOK, evidence.BOOK, ranking.BOOK, selection.BOOK, reports.BOOK, extraction.BOOK, lookups.BOOK)

QUERIES = {name: f for book in BOOKS for name, f in book.queries.items()}
SQL = {name: text for book in BOOKS for name, text in book.sql.items()}
