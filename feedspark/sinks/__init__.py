"""Writers: feeds to documents, subscription lists and chat payloads."""
