"""All registered queries; importing this module fills the registry."""

from . import desk, files, further, graphs, lookups, more, retrieval, stored, streams, texts  # noqa: F401
from .base import QUERIES, SQL  # noqa: F401
