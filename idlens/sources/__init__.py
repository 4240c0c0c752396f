"""Tables in and out (SRC-*, SNK-*)."""
