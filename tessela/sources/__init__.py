"""Reading, writing and generating tables; configuration, index registry and execution log."""
