"""Errors of the store."""


class StoreError(Exception):
    """Any error of the store."""


class IoFailure(StoreError):
    """The file system failed."""


class Corruption(StoreError):
    """Stored data contradicts itself."""


class InvalidConfig(StoreError):
    """An option, a bound or an argument is outside what is allowed; the store stays usable."""


class Locked(StoreError):
    """Another store has the folder open."""


class Background(StoreError):
    """An earlier write or maintenance step failed, so what is stored is not known until the store is opened again."""


class Closed(StoreError):
    """The store was closed."""


class SequenceExhausted(StoreError):
    """There are no sequence numbers left."""
