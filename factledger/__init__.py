"""factledger: a PySpark-native engine for a bitemporal, layer-scoped fact ledger."""

__version__ = "0.1.0"
