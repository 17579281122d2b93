from millrace.repl import main

main()
