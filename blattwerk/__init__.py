"""blattwerk: DataFrame operators for versioned collections of legal and regulatory documents."""

__version__ = "0.1.0"
