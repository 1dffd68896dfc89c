"""The inventory has no streaming operators; nothing is made up here."""
