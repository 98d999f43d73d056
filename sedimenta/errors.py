"""The typed outcomes of the engine."""


class UnknownProfileMetricError(ValueError):
    """A metric or preset nobody knows; raised before any read."""


class InvalidIdentifierError(ValueError):
    """An unsafe column, table or type name."""


class InvalidDeduplicationKeyError(ValueError):
    """A record without a usable primary key, in strict mode."""


class DeduplicationError(RuntimeError):
    """Deduplication exceeded its limit."""


class FlattenCollisionError(ValueError):
    """Two paths of one record give one column name."""


class MissingDateFieldError(ValueError):
    """A dated window without a date field, or a record without a valid date."""


class MissingStateStoreError(ValueError):
    """An increment that nobody keeps the checkpoint of."""


class PaginationLimitError(RuntimeError):
    """More pages than allowed."""


class PaginationLoopError(RuntimeError):
    """A request state came back."""


class CrossOriginPaginationError(RuntimeError):
    """A next URL leads to another origin."""


class InvalidHttpMethodError(ValueError):
    """Neither GET nor POST."""


class InvalidBatchSizeError(ValueError):
    """A batch size out of bounds."""


class InvalidExtractionBatchSizeError(ValueError):
    """An extraction batch size that is no positive integer."""


class StateConflictError(RuntimeError):
    """Another run moved the checkpoint first."""


class AdapterNotFoundError(LookupError):
    """No adapter of that name."""


class PipelineConfigError(ValueError):
    """A configuration that cannot be used."""


class ScheduledPipelineError(RuntimeError):
    """A scheduled run failed."""


class HttpRequestError(RuntimeError):
    """A request failed; the message holds only a sanitised target."""


class UnsafeUrlError(ValueError):
    """A URL the client refuses to call."""


class InsecureUrlError(UnsafeUrlError):
    """A plain http URL."""


class InsecureTlsError(ValueError):
    """TLS verification switched off."""


class UnsafeRedirectError(HttpRequestError):
    """A redirect to another origin or too many of them."""


class ResponseTooLargeError(HttpRequestError):
    """A body above the cap."""


class InvalidAuthValueError(ValueError):
    """A credential with characters that no header may carry."""
