"""Spark engine that turns tables, JSON records, text and web pages into search-ready items
and measures how well answers are grounded in them."""

from itemforge.config import EnrichConfig
from itemforge.session import build_session

__all__ = ["EnrichConfig", "build_session"]
