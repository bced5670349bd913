"""Errors that callers of the API are meant to see as they are."""

from __future__ import annotations


class NotFound(LookupError):
    """No such corpus or section; the message names what there is instead."""


class AlreadyIngested(ValueError):
    """The corpus holds a document with the same bytes."""


class ModelMismatch(ValueError):
    """The store was made with another embedding model or width."""


def guarded(call, *args, **kwargs):  # noqa: ANN001, ANN002, ANN003, ANN201
    """(result, None) or (None, message): expected errors by their message, others by type and 300 characters."""
    try:
        return call(*args, **kwargs), None
    except (NotFound, ValueError) as e:
        return None, str(e)
    except Exception as e:  # the boundary to a client
        return None, f"{type(e).__name__}: {str(e)[:300]}"
