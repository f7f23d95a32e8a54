"""The engine's operators run over the driver's tables, with the SQL that gives the same rows."""
