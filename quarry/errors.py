"""Errors of the store, each with a stable status number."""


class StoreError(Exception):
    status = 0


class NotAnObject(StoreError):
    status = 1


class IdMustBeString(StoreError):
    status = 2


class DuplicateId(StoreError):
    status = 3


class InvalidUpdate(StoreError):
    status = 4


class NoIndex(StoreError):
    status = 5


class PrimaryIndex(StoreError):
    status = 6


class NoMatch(StoreError):
    status = 7


class IdMismatch(StoreError):
    status = 8


class VectorDimMismatch(StoreError):
    status = 9


class Conflict(StoreError):
    status = 10
