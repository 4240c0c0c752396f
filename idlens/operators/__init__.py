"""DataFrame operators over OCR text, QR payloads, registries and sessions."""
