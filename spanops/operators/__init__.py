"""Reports over spans, logs, metric points and orders; each takes and returns DataFrames."""
