"""Reading captured metadata, pages, chunk artifacts and tables; writing artifacts and progress."""
