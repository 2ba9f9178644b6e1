"""Analytical operators over the corpus tables; each module registers its queries."""
