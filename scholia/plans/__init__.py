"""Plans that compose operators end to end: request assembly, note runs, practice exams."""
