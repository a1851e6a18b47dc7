"""eventrail: event decoding, admission, validation, routing and replay on Spark."""

__version__ = "0.1.0"
