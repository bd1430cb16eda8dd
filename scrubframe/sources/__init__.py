"""Readers and writers of tag tables, text boxes, rules, file lists and reports."""
