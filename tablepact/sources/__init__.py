"""Sources and sinks: tables, contract documents, findings writers."""
