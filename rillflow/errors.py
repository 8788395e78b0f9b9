"""Exceptions that users raise or see."""


class InvalidMessageError(Exception):
    """Raised by a callable for a message that must not be retried; it goes to the dead letters if there are any."""


class InvalidPipelineError(Exception):
    """The graph of steps is malformed, e.g. a branch doesn't end in a sink."""


class ConfigEnvError(Exception):
    """A configuration value names an environment variable that isn't set."""
