"""Part of terralapse; see the README."""
