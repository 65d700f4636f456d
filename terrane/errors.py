"""Errors of readers and filters.  Readers raise them inside tasks, so the driver sees their name and text in Spark's error."""


class GeodataError(Exception):
    """Any of the errors below."""


class CorruptedFile(GeodataError):
    """Bytes that break a format's rules."""


class MissingFile(GeodataError):
    """A shape file without its attribute table."""


class UnsupportedShapeType(GeodataError):
    """A record of a kind that the readers don't decode."""


class EncodingError(GeodataError):
    """Text bytes that the declared encoding doesn't have."""


class InvalidGeoJson(GeodataError):
    """A document or geometry outside the supported part of GeoJSON."""


class InvalidMvt(GeodataError):
    """A vector tile that can't be decoded."""


class InvalidGml(GeodataError):
    """Malformed XML or an unsupported geometry."""


class FieldNotFound(GeodataError):
    """No record has the field."""


class DescribeOnNonNumericField(GeodataError):
    """The field has no numbers."""
