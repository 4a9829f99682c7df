"""Readers and writers of the file formats around caption retrieval."""

from .readers import *  # noqa: F403
from .writers import *  # noqa: F403
