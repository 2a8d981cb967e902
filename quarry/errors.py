"""Errors of the library."""


class QuarryError(Exception):
    """Any error raised here."""


class ConfigError(QuarryError, ValueError):
    """A setting that can't be used."""


class RetrievalError(QuarryError):
    """Retrieval could not be carried out."""


class EvalError(QuarryError):
    """Evaluation could not be carried out."""


class ModelError(QuarryError):
    """A model's service failed."""


class ModelAuthError(ModelError):
    """401 or 403."""


class ModelRateError(ModelError):
    """429."""


class ModelServerError(ModelError):
    """5xx, or no answer."""


class ModelRequestError(ModelError):
    """Any other 4xx."""


class ModelAnswerError(ModelError):
    """An answer that can't be read."""
