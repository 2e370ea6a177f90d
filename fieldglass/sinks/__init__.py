"""Text forms of tables, ready for ``write.text``."""
