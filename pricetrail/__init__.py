"""Spark operators over product catalogs and offer price histories."""
