"""Errors of the engine, with the HTTP status a service would give them."""


class EngineError(Exception):
    status = 500


class IngestError(EngineError):
    status = 400


class ExportFormatError(EngineError):
    status = 400


class NotFound(EngineError):
    status = 404


class NotReady(EngineError):
    """The job exists and is not done."""

    status = 409
