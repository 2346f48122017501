"""What can go wrong before a query runs."""


class ParseError(ValueError):
    """The text isn't a query of the dialect."""


class NoTableScanError(RuntimeError):
    """A query under ``notablescan`` that no index serves."""


class UnsupportedQueryError(RuntimeError):
    """A query that this kind of table or catalog can't answer."""


class ShardKeyUpdateError(RuntimeError):
    """An UPDATE of the column that decides a row's shard."""


class ShardLockedError(RuntimeError):
    """A query that touches a shard while it is being moved."""
