"""Journal-entry review on Spark: intake, voucher view, signals, fusion, review."""

__version__ = "0.1.0"
