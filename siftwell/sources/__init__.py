"""Sources and sinks: captured responses, live requests, guidance files, reports."""
