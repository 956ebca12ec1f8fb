"""Connected components of an edge table: the library's own, by hooking of labels."""

from ..plans.hooking import components  # noqa: F401
