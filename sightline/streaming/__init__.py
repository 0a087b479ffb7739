"""Live coverage: growing logs as a stream (``tail``), and the ledger that follows them (``live``)."""
