"""Part of filmspark; see README.md."""
